"""What stands against a reconciliation run before it starts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of a(key, a_from, a_to, ...) and b(key, b_from, b_to, ...) of one key whose closed spans of days overlap, each pair once.

    Spans are spread over the months that they touch, so that overlap is an equi-join on key and month; a pair
    counts in the first month that both touch. Spans without an end, or that end before they begin, overlap nothing.
    """
    month = lambda c: F.trunc(c, "month")

    def spread(df: DataFrame, p: str) -> DataFrame:
        return df.where(F.col(f"{p}_from") <= F.col(f"{p}_to")).withColumn("month_", F.explode(F.sequence(month(f"{p}_from"), month(f"{p}_to"), F.expr("interval 1 month"))))

    x = spread(a, "a").join(spread(b, "b"), [key, "month_"]).where((F.col("a_from") <= F.col("b_to")) & (F.col("b_from") <= F.col("a_to")))
    return x.where(F.col("month_") == month(F.greatest("a_from", "b_from"))).drop("month_")


def preflight(runs: DataFrame, statements: DataFrame, pending: DataFrame) -> DataFrame:
    """run_id, unreconciled, pending, blocked: of runs(run_id, account_id, period_from, period_to, force) the number of
    statements(account_id, period_from, period_to, reconciled) of the account that failed their own check and overlap the
    period, and of the account's pending(account_id, ...) duplicates. A forced run is never blocked.
    """
    a = runs.select("run_id", "account_id", F.col("period_from").alias("a_from"), F.col("period_to").alias("a_to"))
    b = statements.where("not reconciled").select("account_id", F.col("period_from").alias("b_from"), F.col("period_to").alias("b_to"))
    bad = overlaps(a, b, "account_id").groupBy("run_id").agg(F.count(F.lit(1)).alias("unreconciled"))
    open_ = pending.groupBy("account_id").agg(F.count(F.lit(1)).alias("pending"))
    x = runs.join(bad, "run_id", "left").join(open_, "account_id", "left")
    n = {c: F.coalesce(c, F.lit(0)).alias(c) for c in ("unreconciled", "pending")}
    x = x.select("run_id", *n.values(), "force")
    return x.select("run_id", "unreconciled", "pending", (~F.coalesce("force", F.lit(False)) & (F.col("unreconciled") + F.col("pending") > 0)).alias("blocked"))
