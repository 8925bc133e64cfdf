"""Structured Streaming forms of usage metering and of alert de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_usage(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and value by type and tumbling window; the same code for a stream (with a watermark) and a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_cents")).select(F.col("w.start").alias("start"), "event_type", "n", "value_cents")


def alerts_once(alerts: DataFrame, late: str = "3 days") -> DataFrame:
    """The first alert of each fingerprint (account, amount, direction, reference, day) within the watermark."""
    fingerprint = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("account_id", "amount_paise", "direction", "reference_no")], F.to_date("ts").cast("string")), 256)
    return alerts.withColumn("fingerprint", fingerprint).withWatermark("ts", late).dropDuplicatesWithinWatermark(["fingerprint"])
