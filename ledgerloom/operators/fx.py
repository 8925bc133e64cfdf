"""As-of exchange rates, conversion, quote checks and cross rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The band of plausible quotes and the largest step from the last one.
LEAST_RATE, MOST_RATE, LARGEST_STEP = 0.0001, 1000, 0.10


def validity(rates: DataFrame) -> DataFrame:
    """Each quote with the day before which it holds; the earliest of a code also holds before its own day."""
    w = Window.partitionBy("code").orderBy("as_of")
    return rates.select("code", "as_of", "inr_per_unit", F.when(F.lag("as_of").over(w).isNull(), F.lit("0001-01-01").cast("date")).otherwise(F.col("as_of")).alias("from_day"), F.coalesce(F.lead("as_of").over(w), F.lit("9999-12-31").cast("date")).alias("to_day"))


def with_rate(txn: DataFrame, rates: DataFrame, code: str) -> DataFrame:
    """txn with inr_per_unit: the newest rate at the date, before the first quote that one; null dates take the latest.

    Every row stays; without quotes of the code the rate is null. Quotes are spread over the months in which
    they hold, within the span of all quotes, and rows outside it go to its ends: the band meets within equal months.
    """
    month = lambda c: F.date_trunc("month", c).cast("date")
    of = rates.where(F.col("code") == code)
    first, last = of.agg(month(F.min("as_of"))).scalar(), of.agg(month(F.max("as_of"))).scalar()
    v = validity(of).withColumns({"first": first, "last": last})
    v = v.select("inr_per_unit", "from_day", "to_day", F.explode(F.sequence(month(F.col("as_of")), F.least(month(F.date_sub("to_day", 1)), "last"), F.expr("interval 1 month"))).alias("rate_month"))
    day = F.coalesce("txn_date", F.lit("9999-12-30").cast("date"))
    x = txn.withColumns({"rate_day": day, "rate_month": F.greatest(F.least(month(day), last), first)})
    return x.join(v, (x.rate_month == v.rate_month) & (F.col("rate_day") >= F.col("from_day")) & (F.col("rate_day") < F.col("to_day")), "left").drop("rate_month", "rate_day", "from_day", "to_day")


def half_up(amount: Column, rate: Column) -> Column:
    return F.round(amount.cast("decimal(20,0)") / rate, 0).cast("long")


def convert(txn: DataFrame, rates: DataFrame, code: str) -> DataFrame:
    """txn_id, inr_per_unit, converted: minor units of `code` by the rate at the date, rounded half up once."""
    return with_rate(txn, rates, code).select("txn_id", F.col("inr_per_unit").cast("double").alias("inr_per_unit"), half_up(F.col("amount_paise"), F.col("inr_per_unit")).alias("converted"))


def vet_quotes(quotes: DataFrame) -> DataFrame:
    """quotes(code, as_of, inr_per_unit) with reason: why a quote is refused, null if it is taken.

    The step is measured from the code's last quote that was taken, so refused ones never become the measure. Whether a
    quote is taken hangs on those before it: a code's quotes, a few a day at most, are walked in order by one ordered aggregation.
    """
    rate = F.col("inr_per_unit")
    unfair = F.when(rate <= 0, "not_positive").when(~rate.between(LEAST_RATE, MOST_RATE), "out_of_band")
    x = quotes.withColumn("why", F.coalesce(unfair, F.lit("")))
    walked = x.groupBy("code").agg(F.sort_array(F.collect_list(F.struct("as_of", "inr_per_unit", "why"))).alias("qs"))
    last = F.lit(None).cast("decimal(20,8)")
    start = F.struct(last.alias("last"), F.array().cast("array<struct<as_of:date,inr_per_unit:decimal(20,8),reason:string>>").alias("out"))

    def step(state: Column, q: Column) -> Column:
        far = (q["why"] == "") & F.coalesce(F.abs(q["inr_per_unit"] - state["last"]) > state["last"] * F.lit(LARGEST_STEP).cast("decimal(3,2)"), F.lit(False))
        reason = F.when(q["why"] != "", q["why"]).when(far, F.lit("step_too_large"))
        told = F.struct(q["as_of"].alias("as_of"), q["inr_per_unit"].alias("inr_per_unit"), reason.alias("reason"))
        return F.struct(F.when(reason.isNull(), q["inr_per_unit"]).otherwise(state["last"]).alias("last"), F.concat(state["out"], F.array(told)).alias("out"))

    return walked.select("code", F.inline(F.aggregate("qs", start, step, lambda s: s["out"])))


def upsert_quotes(stored: DataFrame, new: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """One quote for each code and day: of the source that comes first in `order`, of equals the new one."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, order)), F.col("source")), F.lit(0))
    both = stored.withColumn("age", F.lit(1)).unionByName(new.withColumn("age", F.lit(0)))
    best = Window.partitionBy("code", "as_of").orderBy(F.when(rank == 0, len(order) + 1).otherwise(rank), "age", "inr_per_unit")
    return both.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k", "age")


def cross_rates(per_euro: DataFrame, base: str = "INR") -> DataFrame:
    """code, as_of, inr_per_unit from per_euro(code, as_of, rate): units of base for one unit of each code, 8 places."""
    of = per_euro.where(F.col("code") == base).select("as_of", F.col("rate").alias("base_rate"))
    return per_euro.where(F.col("code") != base).join(of, "as_of").select("code", "as_of", F.round(F.col("base_rate") / F.col("rate"), 8).alias("inr_per_unit"))
