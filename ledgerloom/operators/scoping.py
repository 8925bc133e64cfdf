"""Scopes, filters and set operations that panels share: all are joins, semi-joins and windows on keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_scope(txn: DataFrame, accounts: DataFrame, entity: int | None = None, account: int | None = None, bank: int | None = None) -> DataFrame:
    """Rows of an entity's accounts, of one account, or of a bank's accounts; accounts(account_id, entity_id, bank_id).

    A row's own entity counts only where its account has none. `bank` may be an account's id. None asks for no limit.
    """
    a = accounts.select("account_id", F.col("entity_id").alias("of_entity"), "bank_id")
    x = txn.join(a, "account_id", "left")
    if entity is not None:
        x = x.where(F.coalesce("of_entity", "entity_id") == entity)
    if account is not None:
        x = x.where(F.col("account_id") == account)
    if bank is not None:
        x = x.where((F.col("bank_id") == bank) | (F.col("account_id") == bank))
    return x.drop("of_entity", "bank_id")


def of_type(txn: DataFrame, kind: str, rail: Column) -> DataFrame:
    """debit and credit are directions, anything else a payment rail."""
    return txn.where(F.col("direction") == kind) if kind in ("debit", "credit") else txn.where(rail == kind)


def in_period(rows: DataFrame, day: str, since: str, until: str) -> DataFrame:
    """Rows of since..until and those without a day."""
    return rows.where(F.col(day).isNull() | F.col(day).between(F.lit(since).cast("date"), F.lit(until).cast("date")))


def outflows(txn: DataFrame, search: str | None = None) -> DataFrame:
    """The nine columns that outflow panels read, of debits, optionally with a word in narration or party."""
    x = txn.where("debit_paise > 0")
    if search:
        x = x.where(F.concat_ws(" ", "narration", "counterparty").ilike(f"%{search}%"))
    return x.select("txn_id", "account_id", "entity_id", "txn_date", "debit_paise", "narration", "counterparty", "reference_no", "statement_id")


def needs_decision(confidence: str = "confidence", category: str = "category", manual: str = "manual") -> Column:
    """Not decided by hand, and without a category, with the word for none, or below 0.7."""
    return ~F.coalesce(manual, F.lit(False)) & (F.col(category).isNull() | (F.col(category) == "Uncategorised") | (F.coalesce(confidence, F.lit(0.0)) < 0.7))


def review_queue(txn: DataFrame, predictions: DataFrame) -> DataFrame:
    """Rows that need a decision with what was predicted, unpredicted ones too."""
    return txn.join(predictions, "txn_id", "left").where(needs_decision()).select("txn_id", "counterparty", "amount_paise", "category", "confidence")


def last_write(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def previous_run(runs: DataFrame, key: str, day: str, run: str) -> DataFrame:
    """Each completed run with the completed one of its key before it."""
    w = Window.partitionBy(key).orderBy(day, run)
    return runs.where("completed").withColumn("previous", F.lag(run).over(w))


def not_renewed(old: DataFrame, new: DataFrame, key: str = "fingerprint") -> DataFrame:
    """What was found before and isn't now: to be closed."""
    return old.join(new.select(key).distinct(), key, "left_anti")


def counter_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, both, either: multiset intersection and union of two columns of keys."""
    n = lambda df, c: df.groupBy(key).agg(F.count(F.lit(1)).alias(c))
    x = n(a, "x").join(n(b, "y"), key, "full").select(key, F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    return x.select(key, F.least("x", "y").alias("both"), F.greatest("x", "y").alias("either"))


def decisions(events: DataFrame, party: str, choice: str, order: list[str]) -> DataFrame:
    """party, choice, confirmed: the last decision of each party and how often it was confirmed since it last changed."""
    w = Window.partitionBy(party).orderBy(*order)
    changed = F.lag(choice).over(w).isNull() | (F.lag(choice).over(w) != F.col(choice))
    x = events.where(F.col(choice).isNotNull()).withColumn("c_", changed.cast("int")).withColumn("run_", F.sum("c_").over(w))
    g = x.groupBy(party, "run_").agg(F.first(choice).alias(choice), F.count(F.lit(1)).alias("confirmed"))
    return g.groupBy(party).agg(F.max_by(choice, "run_").alias(choice), F.max_by("confirmed", "run_").alias("confirmed"))


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, with its place in order of first coming."""
    g = rows.groupBy(key).agg(F.min(order).alias("first"))
    return g.select(key, F.row_number().over(Window.orderBy("first", key)).alias("place"))


def unique_files(files: DataFrame, owner: str, key: str, content: str) -> DataFrame:
    """Of files with equal content of an owner the first: owner, digest, kept, copies."""
    x = files.select(owner, key, F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("digest"))
    return x.groupBy(owner, "digest").agg(F.min(key).alias("kept"), F.count(F.lit(1)).alias("copies"))
