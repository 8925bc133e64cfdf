"""Placement of rows in a category tree, and views of its levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .classify import first_of

#: Path separator and ordered evidence: (path, narration pattern).
SEPARATOR = ">"
PLACES = [
    ("Refunds>Reversal", "REVERSAL"), ("Income>Salary", "SALARY"), ("Housing>Loan>Instalment", "EMI.*HOME"), ("Loans>Instalment", "EMI|LOAN"), ("Housing>Rent", "RENT"),
    ("Charges>Penal", "PENAL"), ("Charges>Return", "CHQ RETURN"), ("Bills>Electricity", "ELECTRICITY"), ("Cash>Withdrawal", "ATM|CASH WITHDRAWAL"), ("Cash>Deposit", "CASH DEP"), ("Transfers>UPI", "^UPI"), ("Transfers>IMPS", "IMPS"),
]


def place(txn: DataFrame) -> DataFrame:
    """txn with its path; rows without evidence go under Other>Income or Other>Expense by direction."""
    rest = F.when(F.col("direction") == "credit", "Other>Income").otherwise("Other>Expense")
    return txn.withColumn("path", first_of(F.upper("narration"), PLACES, rest))


def _under(placed: DataFrame, prefix: str) -> DataFrame:
    return placed if not prefix else placed.where((F.col("path") == prefix) | F.startswith("path", F.lit(prefix + SEPARATOR)))


def drilldown(placed: DataFrame, prefix: str = "") -> DataFrame:
    """The children of a node: rows, in, out, and whether they have children; rows at the node itself have child null."""
    depth = len(prefix.split(SEPARATOR)) if prefix else 0
    parts = F.split("path", SEPARATOR)
    x = _under(placed, prefix).withColumn("child", F.try_element_at(parts, F.lit(depth + 1)))
    return x.groupBy("child").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("credit_paise"), F.lit(0)).cast("long").alias("in_paise"), F.coalesce(F.sum("debit_paise"), F.lit(0)).cast("long").alias("out_paise"),
        F.bool_or(F.size(parts) > depth + 1).alias("has_children"),
    )


def rows_at(placed: DataFrame, prefix: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of the rows under a node, newest first."""
    return _under(placed, prefix).orderBy(F.desc("txn_date"), F.desc("txn_id")).offset(offset).limit(limit).select("txn_id", "txn_date", "path", "amount_paise")


def coverage(placed: DataFrame) -> DataFrame:
    """Rows and money by depth, and by whether there was evidence."""
    return placed.groupBy(F.size(F.split("path", SEPARATOR)).alias("depth"), (~F.startswith("path", F.lit("Other>"))).alias("known")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").cast("long").alias("amount_paise"))
