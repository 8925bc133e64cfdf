"""Period reports, breaches, party groups, classification health and usage figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .dashboards import latest_balance


def period_report(txn: DataFrame, since: str, until: str, side: str | None = None) -> DataFrame:
    """Rows of [since, until), of one side if named, with the total of that side (or the net) on each."""
    amount = {"debit": "debit_paise", "credit": "credit_paise", None: "signed_paise"}[side]
    x = txn.where((F.col("txn_date") >= F.lit(since).cast("date")) & (F.col("txn_date") < F.lit(until).cast("date")))
    if side:
        x = x.where(F.col(amount) > 0)
    total = x.agg(F.sum(amount).cast("long")).scalar()
    return x.select("txn_id", "txn_date", "account_id", "narration", F.col(amount).alias("value_paise"), total.alias("total_paise"))


def breaches(txn: DataFrame, least: int) -> DataFrame:
    """Accounts whose latest balance is below `least`, with what is short."""
    return latest_balance(txn).where(F.col("balance_paise") < least).select("account_id", "balance_paise", (F.lit(least) - F.col("balance_paise")).cast("long").alias("short_paise"))


def party_groups(txn: DataFrame, samples: int = 3) -> DataFrame:
    """Per party: rows, money, spellings, first and last day, commonest spelling and the first `samples` spellings.

    Spellings are counted first, so only (party, spelling) pairs are ranked, and a group keeps few of them.
    """
    s = txn.groupBy("counterparty", "narration").agg(F.count(F.lit(1)).alias("k"), F.sum("amount_paise").alias("a"), F.min("txn_date").alias("f"), F.max("txn_date").alias("l"))
    g = s.groupBy("counterparty").agg(
        F.sum("k").cast("long").alias("n"), F.sum("a").cast("long").alias("amount_paise"), F.count("narration").alias("spellings"),
        F.min("f").alias("first_date"), F.max("l").alias("last_date"), F.max(F.struct("k", "narration"))["narration"].alias("spelling"),
    )
    few = s.where("narration is not null").withColumn("r", F.row_number().over(Window.partitionBy("counterparty").orderBy("narration"))).where(F.col("r") <= samples)
    few = few.groupBy("counterparty").agg(F.concat_ws(" | ", F.sort_array(F.collect_list("narration"))).alias("samples"))
    return g.join(few, "counterparty", "left")


def health(scored: DataFrame, family: str, score: str) -> DataFrame:
    """Rows and mean score (floor) of each evidence family."""
    return scored.groupBy(F.col(family).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.floor(F.sum(score) / F.count(score)).cast("long").alias("mean_score"))


def usage_summary(events: DataFrame, since: str, until: str) -> DataFrame:
    """Events of [since, until) by type: count, value, and nearest-rank 95th percentile in cents.

    The percentile counts distinct values of a type, which partial aggregation merges.
    """
    x = events.where((F.col("ts") >= F.lit(since).cast("timestamp")) & (F.col("ts") < F.lit(until).cast("timestamp"))).withColumn("c", F.round(F.col("value") * 100).cast("long"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("c").cast("long").alias("value_cents"), F.expr("percentile_disc(0.95) within group (order by c)").cast("long").alias("p95_cents"))
