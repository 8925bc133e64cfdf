"""Detectors of anomalies and policy breaches: each gives (kind, severity, account_id, txn_id, amount_paise).

`detect_all` computes neighbours and statistics once and reads all single-row detectors off them. Amounts are paise: a lakh of rupees is 10^7.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAKH = 10**7
#: Words of the single-row detectors, any of which a narration must contain.
KEYWORDS = {
    "cash_withdrawal": ("high", ["ATM", "CASH WDL", "CWDR", "SELF", "ATM-WDL", "NFS*", "CASH WITHDRAWAL"]),
    "penal_charge": ("medium", ["PENAL", "BOUNCE CHG", "MIN BAL", "CONSOL CHG", "OD INT", "OVERDRAFT FEE", "INSUFFICIENT FUNDS FEE", "CHEQUE RETURN CHG", "ECS REJECT"]),
    "reversal": ("medium", ["REVERSAL", "RETURN", "BOUNCED", "REVERSED", "REV-", "DECLINE", "UNPAID"]),
    "risky_merchant": ("high", ["CASINO", "BETTING", "DREAM11", "POKER", "CRYPTO", "BINANCE", "LOTTERY", "RUMMY"]),
    "international": ("medium", ["FOREX", "FCY", "CROSS BORDER", "INTERNATIONAL", "USD ", "EUR ", "GBP ", "AED ", "FOREIGN CURRENCY", "MARKUP FEE"]),
    "penal_interest": ("medium", ["PENAL INTEREST", "INT.DR", "OVERDRAFT INTEREST"]),
    "cheque_return": ("high", ["CHQ RTN", "CHEQUE RETURN", "DISHONOUR", "INSUFFICIENT FUNDS", "CHEQUE BOUNCE"]),
}


def pattern(words: list[str]) -> str:
    """The words as one regex of alternatives."""
    return "|".join(w.replace(".", "[.]").replace("*", "[*]") for w in words)


def with_context(txn: DataFrame) -> DataFrame:
    """txn with what the detectors look at: neighbours in the account, statistics of account and party.

    One shuffle by account serves all account windows; party statistics are one aggregation.
    """
    account, at = Window.partitionBy("account_id"), Window.partitionBy("account_id").orderBy("txn_date", "txn_id")
    debit = F.when(F.col("debit_paise") > 0, F.col("debit_paise"))
    party = txn.groupBy("counterparty").agg(F.min(F.struct("txn_date", "txn_id"))["txn_id"].alias("party_first"), F.median(debit).alias("party_median"), F.count(debit).alias("party_debits"))
    x = txn.join(party, txn.counterparty.eqNullSafe(party.counterparty), "left").drop(party.counterparty)
    ahead = {f"{c}_{k}": F.lead(n, k).over(at) for k in (1, 2, 3) for c, n in (("next_debit", "debit_paise"), ("next_date", "txn_date"))}
    return x.withColumns({
        "prev_date": F.lag("txn_date").over(at), "prev_balance": F.lag("balance_paise").over(at), "account_rows": F.count(F.lit(1)).over(account),
        "debit_mean": F.avg(debit).over(account), "debit_sd": F.stddev_samp(debit).over(account), "account_debits": F.count(debit).over(account), **ahead})


def detectors(today: str) -> list[tuple[str, str, Column]]:
    """(kind, severity, condition on with_context's rows) of every single-row detector."""
    debit, said = F.col("debit_paise"), F.upper("narration")
    out = [(kind, severity, said.rlike(pattern(words))) for kind, (severity, words) in KEYWORDS.items()]
    more = {"cash_withdrawal": debit >= 2 * LAKH, "penal_charge": debit > 0, "penal_interest": debit > 0}
    out = [(k, s, c & more[k] if k in more else c) for k, s, c in out]
    leaves = F.lit(False)
    for k in (1, 2, 3):
        leaves |= F.coalesce((F.col(f"next_debit_{k}") * 100 >= F.col("credit_paise") * 95) & (F.datediff(f"next_date_{k}", "txn_date") <= 1), F.lit(False))
    return out + [
        ("first_large_transfer", "high", (F.col("txn_id") == F.col("party_first")) & (debit >= 5 * LAKH)),
        ("amount_outlier", "high", (F.col("account_debits") >= 25) & (debit > F.col("debit_mean") + 3.8 * F.col("debit_sd")) & (debit >= 5 * LAKH)),
        ("weekend_debit", "low", (F.weekday("txn_date") >= 5) & (debit >= 10 * LAKH)),
        ("activity_gap", "medium", (F.col("account_rows") >= 15) & (F.datediff("txn_date", "prev_date") > 60)),
        ("party_spike", "medium", (F.col("party_debits") >= 5) & (debit > 2 * F.col("party_median")) & (debit - F.col("party_median") >= 2 * LAKH)),
        ("balance_break", "high", F.abs(F.abs(F.col("balance_paise") - F.col("prev_balance")) - F.col("amount_paise")) > 100),
        ("pass_through", "critical", (F.col("credit_paise") >= 10 * LAKH) & leaves),
        ("future_date", "medium", F.col("txn_date") > F.date_add(F.lit(today).cast("date"), 2)),
    ]


def daily_surge(txn: DataFrame, sigmas: float = 3.8, days: int = 20, least: int = 15) -> DataFrame:
    """Days with many more rows than the account's active days have; txn_id is the day's first."""
    d = txn.groupBy("account_id", "txn_date").agg(F.count(F.lit(1)).alias("c"), F.min("txn_id").alias("txn_id"), F.sum("amount_paise").cast("long").alias("amount_paise"))
    s = d.groupBy("account_id").agg(F.avg("c").alias("m"), F.stddev_samp("c").alias("s"), F.count(F.lit(1)).alias("k"))
    hit = d.join(s, "account_id").where((F.col("k") >= days) & (F.col("c") > F.col("m") + sigmas * F.col("s")) & (F.col("c") >= least))
    return hit.select(F.lit("daily_surge").alias("kind"), F.lit("medium").alias("severity"), "account_id", "txn_id", "amount_paise")


def detect_all(txn: DataFrame, today: str) -> DataFrame:
    """kind, severity, account_id, txn_id, amount_paise of all findings: one pass over the rows, and one over the days."""
    hits = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, c in detectors(today)]))
    rows = with_context(txn).select("account_id", "txn_id", "amount_paise", F.explode(hits).alias("x"))
    return rows.select("x.kind", "x.severity", "account_id", "txn_id", "amount_paise").unionByName(daily_surge(txn))


def findings_overview(found: DataFrame) -> DataFrame:
    """Different findings by kind and severity."""
    return found.dropDuplicates(["kind", "account_id", "txn_id"]).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").cast("long").alias("amount_paise"))


# ---- policy rules


def daily_cash(txn: DataFrame, limit: int) -> DataFrame:
    cash = txn.where(F.upper("narration").rlike("CASH"))
    return cash.groupBy("account_id", "txn_date").agg(F.sum("amount_paise").cast("long").alias("amount_paise"), F.count(F.lit(1)).alias("n")).where(F.col("amount_paise") >= limit)


def daily_outflow(txn: DataFrame, cap: int) -> DataFrame:
    return txn.where("debit_paise > 0").groupBy("account_id", "txn_date").agg(F.sum("debit_paise").cast("long").alias("out_paise"), F.count(F.lit(1)).alias("n")).where(F.col("out_paise") >= cap)


def daily_count(txn: DataFrame, limit: int) -> DataFrame:
    return txn.groupBy("account_id", "txn_date").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > limit) & F.lit(limit > 0))


def minimum_balance(txn: DataFrame, limit: int) -> DataFrame:
    """The lowest balance of each account and day below the limit, and the first row that had it."""
    return txn.groupBy("account_id", "txn_date").agg(F.min("balance_paise").alias("low_paise"), F.min(F.struct("balance_paise", "txn_id"))["txn_id"].alias("txn_id")).where(F.col("low_paise") < limit)


def compliance(txn: DataFrame, outflow_cap: int, count_limit: int, low: int) -> DataFrame:
    """For each rule: checks that apply, violations, and passes in basis points (null where nothing applies)."""
    days = txn.groupBy("account_id", "txn_date").agg(F.sum("debit_paise").alias("o"), F.count(F.lit(1)).alias("n"), F.min("balance_paise").alias("b"))
    rules = [("daily_outflow", F.col("o").isNotNull(), F.col("o") >= outflow_cap), ("daily_count", F.lit(True), F.col("n") > count_limit), ("minimum_balance", F.col("b").isNotNull(), F.col("b") < low)]
    one = days.agg(*[F.sum((a & v).cast("long") if kind else a.cast("long")).alias(f"{name}_{kind}") for name, a, v in rules for kind in (0, 1)])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.coalesce(f"{n}_0", F.lit(0)).cast("long").alias("applicable"), F.coalesce(f"{n}_1", F.lit(0)).cast("long").alias("violations")) for n, _, _ in rules])
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("pass_bp", F.when(F.col("applicable") > 0, F.floor((F.col("applicable") - F.col("violations")) * 10000 / F.col("applicable"))).cast("long"))
