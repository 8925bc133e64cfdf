"""Row rules, in-file duplicates and the three kinds of balance continuity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def row_rules(rows: DataFrame, ceiling: int = 5 * 10**9) -> DataFrame:
    """txn_id, errors: the fatal and warning codes of each row, comma-joined in rule order ('' if clean)."""
    codes = F.array(
        F.when(F.col("txn_date").isNull(), "date_missing"),
        F.when(F.col("debit_paise").isNotNull() & F.col("credit_paise").isNotNull(), "both_sides"),
        F.when(F.coalesce("debit_paise", "credit_paise", F.lit(0)) == 0, "no_amount"),
        F.when(F.greatest("debit_paise", "credit_paise") > ceiling, "too_large"),
        F.when(F.col("balance_paise") < 0, "overdrawn"),
    )
    return rows.select("txn_id", F.array_join(F.array_compact(codes), ",").alias("errors"))


def duplicates_in_file(rows: DataFrame) -> DataFrame:
    """Later rows of a statement with the key of an earlier one: txn_id, first_id.

    Instant payments go by reference, or 60 characters of narration without one; other rows by 80 characters
    of narration. Day, side, amount and balance are in both keys, so real repeats, whose balance moved, stay.
    """
    said = F.lower(F.trim(F.regexp_replace(F.coalesce("narration", F.lit("")), r"\s+", " ")))
    upi = F.coalesce(F.upper("narration").contains("UPI"), F.lit(False))
    ref = F.upper(F.trim(F.coalesce("reference_no", F.lit(""))))
    words = F.when(upi, F.when(ref != "", ref).otherwise(F.substring(said, 1, 60))).otherwise(F.substring(said, 1, 80))
    key = ["statement_id", "txn_date", "direction", "amount_paise", F.coalesce("balance_paise", F.lit(0)), upi, words]
    w = Window.partitionBy(*key).orderBy("row_index", "txn_id")
    x = rows.where("statement_id is not null").select("txn_id", F.first("txn_id").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("first_id"))
    return x.where("txn_id <> first_id")


def continuity(rows: DataFrame, tolerance: int = 100) -> DataFrame:
    """For each statement: step pairs that can be checked, and those that hold under the asset or liability sign."""
    w = Window.partitionBy("statement_id").orderBy("txn_date", "row_index")
    x = rows.withColumn("prev", F.lag("balance_paise").over(w)).where("prev is not null and balance_paise is not null")
    step = F.col("balance_paise") - F.col("prev")
    ok = (F.abs(step - F.col("signed_paise")) <= tolerance) | (F.abs(step + F.col("signed_paise")) <= tolerance)
    return x.groupBy("statement_id").agg(F.count(F.lit(1)).alias("checked"), F.sum(ok.cast("long")).alias("ok"))


def statement_check(rows: DataFrame) -> DataFrame:
    """Opening (derived from the first row) + in - out against the last balance: PASSED, FAILED or NOT_VERIFIABLE."""
    o = F.struct("txn_date", "row_index")
    g = rows.groupBy("statement_id").agg(
        F.min_by(F.col("balance_paise") - F.col("signed_paise"), o).alias("opening"), F.max_by("balance_paise", o).alias("closing"), F.sum("signed_paise").cast("long").alias("net"), F.count(F.lit(1)).alias("n"))
    return g.select("statement_id", "opening", "closing", "net", "n", F.when(F.col("opening").isNull() | F.col("closing").isNull(), "NOT_VERIFIABLE").when(F.col("opening") + F.col("net") == F.col("closing"), "PASSED").otherwise("FAILED").alias("verdict"))


def canonical_continuity(rows: DataFrame, tolerance: int = 100) -> DataFrame:
    """For each account: neighbours that both state a balance, and those of them whose step is the row's amount."""
    off = F.abs(F.col("balance_paise") - F.col("signed_paise") - F.lag("balance_paise").over(Window.partitionBy("account_id").orderBy("txn_date", "txn_id")))
    return rows.withColumn("off", off).groupBy("account_id").agg(F.count("off").alias("checkable"), F.count(F.when(F.col("off") <= tolerance, 1)).alias("ok"))


def gate(rows: DataFrame, tolerance: int = 100, least: int = 95) -> DataFrame:
    """For each statement: rows kept, copies rejected, continuity in basis points over the rest, and if it passes `least` percent."""
    bad = duplicates_in_file(rows).select("txn_id").distinct()
    signed = F.when(F.col("direction") == "credit", F.col("amount_paise")).otherwise(-F.col("amount_paise"))
    clean = rows.withColumn("signed_paise", signed).join(bad, "txn_id", "left_anti")
    step = F.col("balance_paise") - F.lag("balance_paise").over(Window.partitionBy("statement_id").orderBy("txn_date", "row_index"))
    holds = (F.abs(step - F.col("signed_paise")) <= tolerance) | (F.abs(step + F.col("signed_paise")) <= tolerance)
    g = clean.withColumns({"step": step, "holds": holds}).groupBy("statement_id").agg(F.count(F.lit(1)).alias("clean"), F.count("step").alias("checked"), F.count(F.when(F.col("holds"), 1)).alias("ok"))
    n = rows.groupBy("statement_id").agg(F.count(F.lit(1)).alias("n"))
    return g.join(n, "statement_id").select("statement_id", "clean", (F.col("n") - F.col("clean")).alias("rejected"), F.expr("case when checked > 0 then ok * 10000 div checked end").alias("pass_bp"), ((F.col("checked") > 0) & (F.col("ok") * 100 >= F.col("checked") * least)).alias("accepted"))


def warning_counts(rows: DataFrame, codes: dict) -> DataFrame:
    """How many rows have each of the warnings {code: condition}."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in codes.items()]))
    return rows.select(F.explode(found).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


def invariants(rows: DataFrame) -> DataFrame:
    """One row of counts that are zero in a sound ledger."""
    one, zero = F.lit(1), F.lit(0)
    return rows.agg(
        F.count(one).alias("n"), F.count(F.when(F.col("debit_paise").isNull() & F.col("credit_paise").isNull(), one)).alias("no_side"), F.count(F.when(F.col("amount_paise") <= 0, one)).alias("not_positive"),
        (F.count(one) - F.count_distinct("txn_id")).alias("repeated_ids"), F.sum(F.coalesce("credit_paise", zero) - F.coalesce("debit_paise", zero) - F.col("signed_paise")).cast("long").alias("unbalanced"))
