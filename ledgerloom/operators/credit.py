"""Income, spending, obligations, affordability and risk of each account, in minor units and basis points.

Every block is one or two aggregations by account, or by series, so partial sums leave little to shuffle;
the account-sized results are then joined. Spreads are compared as exact integers: with s = n*sum(x*x) -
sum(x)^2 a population deviation is sqrt(s)/n, and a bound on it becomes a bound on s.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import anomalies
from .classify import first_of
from .timeseries import daily_balance, recurring

#: Narration patterns, and bounds in minor units and basis points.
DEBT = "EMI|LOAN"
PENAL = "PENAL|BOUNCE|CHQ RETURN|CHEQUE RETURN|DISHONOUR|MIN BAL|OVERDRAFT|LATE FEE"
SPENDING = [("essential", "RENT|EMI|LOAN|ELECTRICITY|INSURANCE"), ("cash", "ATM|CASH"), ("transfer", "SELF|UPI|IMPS|NEFT|RTGS"), ("discretionary", "POS|CARD")]
LEAST_DISPOSABLE, COMFORTABLE_BP, STRETCHED_BP = 1_500_000, 4000, 5000
SEVERITY = {"critical": 4, "high": 3, "medium": 2, "low": 1}

_SERIES = ["account_id", "direction", "counterparty"]


def _zero(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0)).cast("long")


def series_evidence(txn: DataFrame) -> DataFrame:
    """Per series: n, months, total, day_spread and amount_spread (s of days and amounts), salary and debt narration."""
    day, amount, text = F.dayofmonth("txn_date").cast("long"), F.col("amount_paise").cast("decimal(18,0)"), F.upper("narration")
    g = txn.groupBy(*_SERIES).agg(
        F.count(F.lit(1)).alias("k"), F.sum(day * day).alias("d2"), F.sum(day).alias("d1"), F.sum((amount * amount).cast("decimal(28,0)")).alias("a2"), F.sum("amount_paise").cast("long").alias("total_paise"),
        F.countDistinct(F.date_trunc("month", "txn_date")).alias("months"), F.bool_or(text.rlike("SALARY")).alias("salary"), F.bool_or(text.rlike(DEBT)).alias("debt"),
    )
    square = F.col("total_paise").cast("decimal(18,0)") * F.col("total_paise").cast("decimal(18,0)")
    return g.select(*_SERIES, "k", "months", "total_paise", "salary", "debt", (F.col("k") * F.col("d2") - F.col("d1") * F.col("d1")).alias("day_spread"), (F.col("a2") * F.col("k").cast("decimal(9,0)") - square).cast("decimal(38,0)").alias("amount_spread"), square.alias("square"))


def _fixed_amount(per_10000: int) -> Column:
    """The coefficient of variation is at most per_10000 / 10000."""
    return F.col("amount_spread") * F.lit(10000 * 10000 // (per_10000 * per_10000)) <= F.col("square")


def _fixed_day(days: int) -> Column:
    return F.col("day_spread") <= days * days * F.col("k") * F.col("k")


def salary(txn: DataFrame) -> DataFrame:
    """The likeliest salary series of each account: confidence in per cent (at least 70, at most 97), median amount."""
    x = recurring(txn).where("direction = 'credit' and cadence is not null").join(series_evidence(txn), _SERIES)
    score = 50 + F.when(F.col("salary"), 20).otherwise(0) + F.when(F.col("n") >= 6, 10).otherwise(0) + F.when(_fixed_amount(500), 7).otherwise(0) + F.when(_fixed_day(3), 5).otherwise(0)
    x = x.withColumn("confidence", F.least(score, F.lit(97)).cast("int")).where("confidence >= 70")
    best = x.groupBy("account_id").agg(F.max(F.struct("confidence", "amount_paise", "counterparty")).alias("b"))
    return best.select("account_id", "b.confidence", "b.amount_paise", "b.counterparty")


def monthly_equivalent(series: DataFrame) -> DataFrame:
    """Per account and direction: the series' amounts a month of 30 days, and the share of series of the high tier."""
    m = F.expr("amount_paise * 30 div nominal_days")
    return series.groupBy("account_id", "direction").agg(F.sum(m).cast("long").alias("monthly_paise"), F.count(F.lit(1)).alias("series"), F.expr("count_if(tier = 'high') * 10000 div count(1)").alias("high_bp"))


def income(txn: DataFrame) -> DataFrame:
    """Per account with credits: total, rows, sources, months with income, largest source and its share."""
    c = txn.where("credit_paise > 0")
    source = c.groupBy("account_id", "counterparty").agg(F.sum("credit_paise").cast("long").alias("s"), F.count(F.lit(1)).alias("k"))
    by = source.groupBy("account_id").agg(F.sum("s").cast("long").alias("total_paise"), F.sum("k").cast("long").alias("n"), F.count(F.lit(1)).alias("sources"), F.max(F.struct("s", "counterparty")).alias("top"))
    months = c.groupBy("account_id").agg(F.countDistinct(F.date_trunc("month", "txn_date")).alias("months"))
    return by.join(months, "account_id").select("account_id", "total_paise", "n", "sources", "months", F.col("top.counterparty").alias("largest"), F.expr("cast(cast(top.s as decimal(38,0)) * 10000 div total_paise as bigint)").alias("largest_bp"))


def expenses(txn: DataFrame) -> DataFrame:
    """Per account with debits: total and its essential, cash, transfer, discretionary and unattributed parts, months."""
    d = txn.where("debit_paise > 0").withColumn("part", first_of(F.upper("narration"), SPENDING, F.lit("unattributed")))
    part = lambda p: _zero(F.sum(F.when(F.col("part") == p, F.col("debit_paise")))).alias(f"{p}_paise")
    return d.groupBy("account_id").agg(F.sum("debit_paise").cast("long").alias("total_paise"), *[part(p) for p, _ in SPENDING], part("unattributed"), F.countDistinct(F.date_trunc("month", "txn_date")).alias("months"))


def obligations(txn: DataFrame) -> DataFrame:
    """Monthly debit series that are instalments, by narration or by a fixed amount on a fixed day; confidence in per cent."""
    x = recurring(txn).where("direction = 'debit' and cadence = 'monthly'").join(series_evidence(txn), _SERIES)
    shape = _fixed_amount(200) & _fixed_day(3)
    x = x.withColumn("confidence", F.when(F.col("debt") & shape, 90).when(F.col("debt"), 80).when(shape, 55)).where("confidence is not null")
    return x.select("account_id", "counterparty", "amount_paise", F.expr("(2 * total_paise + months) div (2 * months)").alias("monthly_paise"), "confidence")


def affordability(txn: DataFrame) -> DataFrame:
    """Per account: monthly income, obligations, essential spending without obligations, ratio and verdict.

    No income: insufficient_data. Less than LEAST_DISPOSABLE left: not_affordable. Else by the ratio of
    obligations to income: affordable, marginal, not_affordable.
    """
    own = income(txn).select("account_id", F.expr("total_paise div months").alias("income_paise"))
    debt = obligations(txn).groupBy("account_id").agg(F.sum("monthly_paise").cast("long").alias("debt_paise"))
    spent = expenses(txn).select("account_id", F.expr("essential_paise div months").alias("essential_paise"))
    x = txn.select("account_id").distinct().join(own, "account_id", "left").join(debt, "account_id", "left").join(spent, "account_id", "left")
    x = x.select("account_id", _zero("income_paise").alias("income_paise"), _zero("debt_paise").alias("debt_paise"), _zero("essential_paise").alias("essential_paise"))
    x = x.withColumn("ratio_bp", F.expr("case when income_paise > 0 then debt_paise * 10000 div income_paise end")).withColumn("left_paise", F.expr("income_paise - greatest(debt_paise, essential_paise)"))
    verdict = F.when(F.col("ratio_bp").isNull(), "insufficient_data").when(F.col("left_paise") < LEAST_DISPOSABLE, "not_affordable").when(F.col("ratio_bp") < COMFORTABLE_BP, "affordable")
    return x.withColumn("verdict", verdict.when(F.col("ratio_bp") < STRETCHED_BP, "marginal").otherwise("not_affordable"))


def risk(txn: DataFrame, today: str, least_balance: int = 0) -> DataFrame:
    """Per account: days, days below zero and below least_balance, penal charges, weighted findings, stress in basis points.

    Stress: 35 % charges (full at 6), 25 % share of negative days, 20 % share of breach days, 20 % findings
    weighted by severity (full at 8); each part is rounded down.
    """
    days = daily_balance(txn).groupBy("account_id").agg(F.count(F.lit(1)).alias("days"), F.expr("count_if(close_paise < 0)").alias("negative_days"), F.count(F.when(F.col("close_paise") < least_balance, 1)).alias("breach_days"))
    fees = txn.where((F.col("debit_paise") > 0) & F.upper("narration").rlike(PENAL)).groupBy("account_id").agg(F.count(F.lit(1)).alias("charges"), F.sum("debit_paise").cast("long").alias("charges_paise"))
    weight = F.coalesce(*[F.when(F.col("severity") == s, w) for s, w in SEVERITY.items()], F.lit(1))
    found = anomalies.detect_all(txn, today).groupBy("account_id").agg(F.sum(weight).cast("long").alias("weighted"))
    x = days.join(fees, "account_id", "left").join(found, "account_id", "left")
    x = x.select("account_id", "days", "negative_days", "breach_days", *[_zero(c).alias(c) for c in ("charges", "charges_paise", "weighted")])
    return x.withColumn("stress_bp", F.expr("3500 * least(charges, 6) div 6 + 2500 * negative_days div days + 2000 * breach_days div days + 2000 * least(weighted, 8) div 8"))


def history_warnings(txn: DataFrame, least_days: int = 90, least_rows: int = 5) -> DataFrame:
    """Per account: days covered, months with rows, and the warnings short_history and sparse_history."""
    g = txn.groupBy("account_id").agg((F.datediff(F.max("txn_date"), F.min("txn_date")) + 1).cast("long").alias("days"), F.countDistinct(F.date_trunc("month", "txn_date")).alias("months"), F.count(F.lit(1)).alias("n"))
    said = F.concat_ws(",", F.when(F.col("days") < least_days, "short_history"), F.when(F.col("n") < least_rows * F.col("months"), "sparse_history"))
    return g.withColumn("warnings", said)


def cash_flow(txn: DataFrame) -> DataFrame:
    """For each account: in, out, net, months and those of surplus, savings in basis points of income, days that the balance lasts."""
    zero = F.lit(0)
    m = txn.groupBy("account_id", F.date_trunc("month", "txn_date").alias("month")).agg(F.coalesce(F.sum("credit_paise"), zero).alias("i"), F.coalesce(F.sum("debit_paise"), zero).alias("o"))
    g = m.groupBy("account_id").agg(F.sum("i").cast("long").alias("in_paise"), F.sum("o").cast("long").alias("out_paise"), F.count(F.lit(1)).alias("months"), F.count(F.when(F.col("i") >= F.col("o"), 1)).alias("surplus_months"))
    last = txn.groupBy("account_id").agg(F.max_by("balance_paise", F.struct("txn_date", "txn_id")).alias("closing"))
    return g.join(last, "account_id").select(
        "account_id", "in_paise", "out_paise", (F.col("in_paise") - F.col("out_paise")).alias("net_paise"), "months", "surplus_months",
        F.when(F.col("in_paise") > 0, F.expr("cast((cast(in_paise as decimal(20,0)) - out_paise) * 10000 div in_paise as bigint)")).alias("savings_bp"),
        F.when((F.col("out_paise") > 0) & (F.col("closing") > 0), F.expr("cast(cast(closing as decimal(20,0)) * months * 30 div out_paise as bigint)")).alias("runway_days"))


def overall_confidence(txn: DataFrame, known) -> DataFrame:
    """Half of rows read, a quarter each of balances that flow and rows whose party is known, in basis points; a missing part counts as 0."""
    at = Window.partitionBy("account_id").orderBy("txn_date", "txn_id")
    off = F.abs(F.col("balance_paise") - F.col("signed_paise") - F.lag("balance_paise").over(at))
    one = F.lit(1)
    g = txn.withColumns({"off": off, "known": known}).groupBy("account_id").agg(F.count(one).alias("n"), F.count("balance_paise").alias("read"), F.count("off").alias("c"), F.count(F.when(F.col("off") <= 100, one)).alias("ok"), F.count(F.when(F.col("known"), one)).alias("k"))
    g = g.select("account_id", F.expr("read * 10000 div n").alias("parse_bp"), F.expr("case when c > 0 then ok * 10000 div c else 0 end").alias("continuity_bp"), F.expr("k * 10000 div n").alias("coverage_bp"))
    return g.withColumn("confidence_bp", F.expr("(2 * parse_bp + continuity_bp + coverage_bp) div 4"))
