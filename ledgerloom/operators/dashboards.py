"""Grouped, ranked, top-k-plus-other and rollup panels over the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def _side(c: str):
    return F.coalesce(F.sum(c), F.lit(0)).cast("long")


def summary(txn: DataFrame) -> DataFrame:
    """One row: totals, counts, latest-balance liquidity over accounts, freshness."""
    last = latest_balance(txn).agg(F.sum("balance_paise").cast("long").alias("liquidity_paise"))
    return txn.agg(
        _side("credit_paise").alias("in_paise"), _side("debit_paise").alias("out_paise"), F.count(F.lit(1)).alias("n"),
        F.countDistinct("account_id").alias("accounts"), F.max("txn_date").alias("last_date"), F.min("txn_date").alias("first_date"),
    ).select("*", last.scalar().alias("liquidity_paise"))


def by_period(txn: DataFrame, unit: str = "month") -> DataFrame:
    """Cash flow by day or month."""
    return txn.groupBy(F.date_trunc(unit, "txn_date").cast("date").alias("period")).agg(
        _side("credit_paise").alias("in_paise"), _side("debit_paise").alias("out_paise"), F.sum("signed_paise").cast("long").alias("net_paise"), F.count(F.lit(1)).alias("n"))


def latest_balance(txn: DataFrame) -> DataFrame:
    """The newest stated balance of each account: date, then row, then id; by a partial aggregate, not a window."""
    return txn.where("balance_paise is not null").groupBy("account_id").agg(F.max_by("balance_paise", F.struct("txn_date", "txn_id")).alias("balance_paise"), F.max("txn_date").alias("txn_date"))


def breakdown(txn: DataFrame, key: str) -> DataFrame:
    """Sums by key with shares of all outflow in basis points (floor; null without outflow)."""
    g = txn.groupBy(key).agg(_side("credit_paise").alias("in_paise"), _side("debit_paise").alias("out_paise"), F.count(F.lit(1)).alias("n"))
    return g.select("*", g.agg(F.sum("out_paise")).scalar().alias("all_")).select(
        key, "in_paise", "out_paise", "n", F.when(F.col("all_") > 0, F.floor(F.col("out_paise") * 10000 / F.col("all_"))).cast("long").alias("share_bp"), F.when(F.col("out_paise") >= F.col("in_paise"), "debit").otherwise("credit").alias("side"))


def top_and_other(txn: DataFrame, key: str, k: int) -> DataFrame:
    """The k keys of largest outflow, and the rest as `Other (n)`."""
    g = txn.where("debit_paise > 0").groupBy(key).agg(F.sum("debit_paise").alias("out_paise"), F.count(F.lit(1)).alias("n"))
    top = g.orderBy(F.desc("out_paise"), key).limit(k)
    rest = g.join(top.select(key), key, "left_anti").agg(F.concat(F.lit("Other ("), F.count(F.lit(1)).cast("string"), F.lit(")")).alias(key), F.sum("out_paise").alias("out_paise"), F.sum("n").alias("n")).where("out_paise is not null")
    return top.unionByName(rest).select(key, F.col("out_paise").cast("long").alias("out_paise"), F.col("n").cast("long").alias("n"))


def concentration(txn: DataFrame, key: str, k: int = 5) -> DataFrame:
    """Outflow to the k largest keys against all outflow, and the number of keys."""
    g = txn.where("debit_paise > 0").groupBy(key).agg(F.sum("debit_paise").alias("s"))
    top = g.orderBy(F.desc("s"), key).limit(k).agg(F.sum("s").cast("long").alias("top_paise"))
    return g.agg(F.count(F.lit(1)).alias("keys"), F.sum("s").cast("long").alias("all_paise")).select("*", top.scalar().alias("top_paise"))


def page(txn: DataFrame, search: str, offset: int, limit: int) -> DataFrame:
    """A page of the newest matching rows, each with the number of all matches."""
    hit = txn.where(F.col("narration").ilike(f"%{search}%"))
    rows = hit.orderBy(F.desc("txn_date"), F.desc("txn_id")).offset(offset).limit(limit).select("txn_id", "txn_date", "amount_paise", "narration")
    return rows.select("*", hit.agg(F.count(F.lit(1))).scalar().alias("total"))


def ageing(items: DataFrame, as_of: str) -> DataFrame:
    """Open items (side, item_date, amount_paise) in bands of age; empty bands stay."""
    bands = items.sparkSession.createDataFrame([(1, "0-30", -(10**6), 30), (2, "31-60", 31, 60), (3, "61-90", 61, 90), (4, "90+", 91, 10**6)], "pos int, band string, lo int, hi int")
    aged = items.withColumn("age", F.datediff(F.lit(as_of).cast("date"), "item_date"))
    aged = aged.withColumn("pos", F.when(F.col("age") <= 30, 1).when(F.col("age") <= 60, 2).when(F.col("age") <= 90, 3).otherwise(4))
    part = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("amount_paise"))), F.lit(0)).cast("long").alias(f"{s}_paise")
    got = aged.groupBy("pos").agg(part("bank"), part("book"), F.count(F.lit(1)).alias("n"))
    return bands.join(got, "pos", "left").select("pos", "band", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("bank_paise", "book_paise", "n")))


def rollup_tree(txn: DataFrame, *levels: str) -> DataFrame:
    """Outflow on every level of a tree of columns, and in all; depth is the number of levels given."""
    return txn.rollup(*levels).agg(_side("debit_paise").alias("out_paise"), F.count(F.lit(1)).alias("n"), sum((1 - F.grouping(x) for x in levels[1:]), 1 - F.grouping(levels[0])).cast("int").alias("depth"))


def recent(txn: DataFrame, k: int) -> DataFrame:
    return txn.orderBy(F.desc("txn_date"), F.desc("txn_id")).limit(k).select("txn_id", "txn_date", "account_id", "signed_paise")


def ranked_in(txn: DataFrame, group: str, k: int) -> DataFrame:
    """The k largest debits of each group."""
    w = Window.partitionBy(group).orderBy(F.desc("debit_paise"), "txn_id")
    return txn.where("debit_paise > 0").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(group, "rank", "txn_id", "debit_paise")
