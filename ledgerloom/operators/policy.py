"""Policy rules over the ledger: each row rule is a condition, all of them one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anomalies import KEYWORDS, LAKH, pattern


@dataclass(frozen=True)
class Rule:
    code: str
    limit_paise: int
    severity: str
    scope: str = "debit"  # debit, credit or any
    words: str | None = None  # a regex that narrations must match
    cash: bool = False
    weekend: bool = False

    def applies(self) -> Column:
        c = {"debit": F.col("debit_paise") > 0, "credit": F.col("credit_paise") > 0, "any": F.lit(True)}[self.scope]
        if self.words:
            c &= F.coalesce(F.col("narration").rlike(f"(?i){self.words}"), F.lit(False))
        if self.cash:
            c &= F.coalesce(F.upper("narration").rlike(pattern(KEYWORDS["cash_withdrawal"][1]) + "|CASH DEP|BY CASH"), F.lit(False))
        return F.coalesce(c, F.lit(False))

    def broken(self) -> Column:
        c = F.col("amount_paise") >= self.limit_paise
        return c & (F.weekday("txn_date") >= 5) if self.weekend else c


#: Limits, severities and narration words of the default single-row rules.
DEFAULT = [
    Rule("expense_limits", 5 * LAKH, "medium"), Rule("required_approvals", 10 * LAKH, "critical"), Rule("supporting_bills", 2 * LAKH, "medium"), Rule("authorized_vendors", 5 * LAKH, "high"), Rule("business_purpose", LAKH, "medium"),
    Rule("no_personal_expense", 100_000, "high", words="swiggy|zomato|netflix|amazon prime|hotstar|pvr|inox|spotify|playstation|steam"),
    Rule("reimbursements", LAKH // 2, "medium", words="reimb|reimbursement|claim|travel claim|allowance"), Rule("documentation", LAKH, "low"),
    Rule("cash_limit", LAKH // 10, "high", cash=True),
]


def violations(txn: DataFrame, rules: list[Rule]) -> DataFrame:
    """code, severity, account_id, txn_id, amount_paise of every row that breaks a rule."""
    hits = F.array_compact(F.array(*[F.when(r.applies() & r.broken(), F.struct(F.lit(r.code).alias("code"), F.lit(r.severity).alias("severity"))) for r in rules]))
    return txn.select("account_id", "txn_id", "amount_paise", F.explode(hits).alias("x")).select("x.code", "x.severity", "account_id", "txn_id", "amount_paise")


def evaluate(txn: DataFrame, rules: list[Rule]) -> DataFrame:
    """code, applicable, violations, pass_bp of every rule, in one aggregation."""
    one = txn.agg(*[F.sum(c.cast("long")).alias(f"{r.code}_{k}") for r in rules for k, c in (("a", r.applies()), ("v", r.applies() & r.broken()))])
    zero = F.lit(0)
    rows = F.array(*[F.struct(F.lit(r.code).alias("code"), F.coalesce(f"{r.code}_a", zero).cast("long").alias("applicable"), F.coalesce(f"{r.code}_v", zero).cast("long").alias("violations")) for r in rules])
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("pass_bp", F.expr("case when applicable > 0 then (applicable - violations) * 10000 div applicable end"))


def ranked_findings(found: DataFrame, most: int) -> DataFrame:
    """The first `most` different findings by severity, then amount, nulls last."""
    rank = F.when(F.col("severity") == "critical", 1).when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 3).otherwise(4)
    return found.dropDuplicates(["kind", "account_id", "txn_id"]).orderBy(rank, F.desc_nulls_last("amount_paise"), "kind", "txn_id").limit(most)


def fingerprint(txn: DataFrame) -> DataFrame:
    """One row by which a scan sees if the ledger changed: rows, sums, last day and an order-free hash."""
    return txn.agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").cast("long").alias("amount_paise"), F.max("txn_date").alias("last_date"), F.sum(F.crc32(F.concat_ws("|", "txn_id", "amount_paise", "direction").cast("binary"))).cast("long").alias("mark"))
