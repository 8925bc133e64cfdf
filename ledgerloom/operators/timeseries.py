"""Daily balances, cash position, recurring series and forecasts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Cadences by the median gap in days (name, nominal days, from, to).
CADENCES = [("daily", 1, 1, 4), ("weekly", 7, 5, 9), ("bi-weekly", 14, 10, 18), ("monthly", 30, 19, 45), ("quarterly", 90, 70, 115), ("semi-annual", 180, 140, 220), ("annual", 365, 300, 420)]


def day_close(txn: DataFrame) -> DataFrame:
    """The last balance of each account and day."""
    return txn.where("balance_paise is not null").groupBy("account_id", "txn_date").agg(F.max_by("balance_paise", F.col("txn_id")).alias("close_paise"))


def daily_balance(txn: DataFrame) -> DataFrame:
    """One row for each account and calendar day from its first to its last, the balance carried forward.

    A close is spread over the days to the next one, so no grid is joined.
    """
    w = Window.partitionBy("account_id").orderBy("txn_date")
    x = day_close(txn).withColumn("until", F.coalesce(F.date_sub(F.lead("txn_date").over(w), 1), F.col("txn_date")))
    return x.select("account_id", F.explode(F.sequence("txn_date", "until")).alias("day"), "close_paise")


def cash_position(txn: DataFrame) -> DataFrame:
    """For each day with activity the sum of the latest balances of the accounts seen so far: running sums of changes."""
    w = Window.partitionBy("account_id").orderBy("txn_date")
    d = day_close(txn)
    d = d.withColumn("change", F.col("close_paise") - F.coalesce(F.lag("close_paise").over(w), F.lit(0)))
    by_day = d.groupBy("txn_date").agg(F.sum("change").alias("change"))  # at most a row for each calendar day
    return by_day.select("txn_date", F.sum("change").over(Window.orderBy("txn_date").rowsBetween(Window.unboundedPreceding, 0)).cast("long").alias("position_paise"))


def balances(txn: DataFrame) -> DataFrame:
    """Opening, closing, extremes and the time-weighted mean (floor) of each account."""
    o = F.struct("txn_date", "txn_id")
    ends = txn.groupBy("account_id").agg(F.min_by(F.col("balance_paise") - F.col("signed_paise"), o).alias("opening"), F.max_by("balance_paise", o).alias("closing"), F.min("balance_paise").alias("low"), F.max("balance_paise").alias("high"))
    mean = daily_balance(txn).groupBy("account_id").agg(F.floor(F.sum("close_paise") / F.count(F.lit(1))).cast("long").alias("mean_paise"), F.count(F.lit(1)).alias("days"))
    return ends.join(mean, "account_id")


def month_buckets(txn: DataFrame) -> DataFrame:
    """In and out of every month of the whole span and account, empty months with zeros."""
    month = lambda f: txn.agg(F.date_trunc("month", f("txn_date")).cast("date")).scalar()
    grid = txn.select("account_id").distinct().select("account_id", month(F.min).alias("a"), month(F.max).alias("b"))
    grid = grid.select("account_id", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    got = txn.groupBy("account_id", F.date_trunc("month", "txn_date").cast("date").alias("month")).agg(F.sum("credit_paise").alias("i"), F.sum("debit_paise").alias("o"))
    zero = F.lit(0)
    return grid.join(got, ["account_id", "month"], "left").select("account_id", "month", F.coalesce("i", zero).cast("long").alias("in_paise"), F.coalesce("o", zero).cast("long").alias("out_paise"))


def recurring(txn: DataFrame, key: str = "counterparty", least: int = 3, tail: int = 10) -> DataFrame:
    """Series of (account, direction, key): rows, median gap, its cadence, and the median of the last amounts."""
    by = ["account_id", "direction", key]
    w = Window.partitionBy(*by).orderBy("txn_date", "txn_id")
    x = txn.withColumn("gap", F.datediff("txn_date", F.lag("txn_date").over(w)))
    x = x.withColumn("back", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("txn_date"), F.desc("txn_id"))))
    g = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("gap").alias("gap"), F.median(F.when(F.col("back") <= tail, F.col("amount_paise"))).alias("m"), F.max("txn_date").alias("last_date")).where(F.col("n") >= least)
    name = nominal = F.lit(None)
    for c, days, lo, hi in reversed(CADENCES):
        name, nominal = F.when(F.col("gap").between(lo, hi), c).otherwise(name), F.when(F.col("gap").between(lo, hi), days).otherwise(nominal)
    return g.select(*by, "n", (F.col("gap") * 2).cast("long").alias("gap_halves"), F.floor("m").cast("long").alias("amount_paise"), "last_date", name.alias("cadence"), nominal.cast("int").alias("nominal_days"), F.when(F.col("n") >= 6, "high").otherwise("medium").alias("tier")).where("cadence is not null")


def forecast(series: DataFrame, horizons: tuple[int, ...] = (30, 60, 90)) -> DataFrame:
    """Expected and conservative (high tier only) in and out over each horizon."""
    x = series.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("value", F.floor(F.col("horizon") / F.col("nominal_days")) * F.col("amount_paise") * F.when(F.col("direction") == "credit", 1).otherwise(-1))
    return x.groupBy("horizon").agg(F.sum("value").cast("long").alias("expected_paise"), F.coalesce(F.sum(F.when(F.col("tier") == "high", F.col("value"))), F.lit(0)).cast("long").alias("conservative_paise"))


def statement_openings(txn: DataFrame, printed) -> DataFrame:
    """statement_id, opening_paise, basis: as printed, else the closing of the account's statement before, else from the first row.

    `printed` is a column over first_open, last_close and statement_id.
    """
    x = txn.groupBy("account_id", "statement_id").agg(F.min_by(F.col("balance_paise") - F.col("signed_paise"), "row_index").alias("first_open"), F.max_by("balance_paise", "row_index").alias("last_close"))
    x = x.withColumns({"printed": printed, "before": F.lag("last_close").over(Window.partitionBy("account_id").orderBy("statement_id"))})
    basis = F.when(F.col("printed").isNotNull(), "reported").when(F.col("before").isNotNull(), "movement").otherwise("reconstructed")
    return x.select("statement_id", F.coalesce("printed", "before", "first_open").alias("opening_paise"), basis.alias("basis"))


def series_members(txn: DataFrame, key: str, least: int) -> DataFrame:
    """Groups of (direction, key) seen in at least `least` months: months, rows, smallest and largest amount."""
    g = txn.groupBy("direction", key).agg(F.count_distinct(F.date_trunc("month", "txn_date")).alias("months"), F.count(F.lit(1)).alias("n"), F.min("amount_paise").alias("low"), F.max("amount_paise").alias("high"))
    return g.where(F.col("months") >= least)


def _over_cuts(df: DataFrame, start: str, end: str, first, last, history: int, horizon: int, step: int) -> DataFrame:
    """A row of df for each cut-off that lies in [start, end): end null is open, so that rows don't multiply beyond what holds then."""
    origin = F.date_add(first, history)
    lo = F.greatest(F.ceil(F.datediff(start, origin) / step), F.lit(0))
    hi = F.floor(F.datediff(F.least(F.date_sub(end, 1), F.date_sub(last, horizon)), origin) / step)
    x = df.withColumns({"origin": origin, "lo": lo.cast("int"), "hi": hi.cast("int")}).where("lo <= hi")
    return x.withColumn("as_of", F.explode(F.transform(F.sequence("lo", "hi"), lambda i: F.date_add("origin", i * step)))).drop("origin", "lo", "hi")


def backtest(txn: DataFrame, key: str = "counterparty", horizon: int = 30, history: int = 90, step: int = 30, least: int = 3, tail: int = 10) -> DataFrame:
    """The forecast replayed: for each cut-off (every `step` days from `history` days on) with a series by then, the balance
    then, the expected and conservative balance `horizon` days on, the balance that came and the error in basis points.

    A series' state after each of its rows (count, median gap, median of the last amounts) holds until its next row, so
    each cut-off takes one row of a series and no history is read again. The error is null where the balance is 0.
    """
    days = (F.min("txn_date"), F.max("txn_date"))
    first, last = (txn.agg(f).scalar() for f in days)
    by = ["account_id", "direction", key]
    w = Window.partitionBy(*by).orderBy("txn_date", "txn_id")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    x = txn.select(*by, "txn_date", "txn_id", "amount_paise").withColumns({"gap": F.datediff("txn_date", F.lag("txn_date").over(w)), "until": F.lead("txn_date").over(w), "n": F.row_number().over(w)})
    x = x.withColumns({"g": F.percentile("gap", F.lit(0.5)).over(so_far), "m": F.percentile("amount_paise", F.lit(0.5)).over(w.rowsBetween(1 - tail, 0))}).where(F.col("n") >= least)
    nominal = F.coalesce(*[F.when(F.col("g").between(lo, hi), d) for _, d, lo, hi in CADENCES])
    value = F.floor(F.lit(horizon) / nominal) * F.floor("m") * F.when(F.col("direction") == "credit", 1).otherwise(-1)
    x = x.select("txn_date", "until", "n", value.alias("value")).where("value is not null")
    s = _over_cuts(x, "txn_date", F.coalesce("until", F.date_add(last, 1)), first, last, history, horizon, step)
    s = s.groupBy("as_of").agg(F.sum("value").cast("long").alias("flow"), F.coalesce(F.sum(F.when(F.col("n") >= 6, F.col("value"))), F.lit(0)).cast("long").alias("sure"))
    p = cash_position(txn).withColumn("until", F.coalesce(F.lead("txn_date").over(Window.orderBy("txn_date")), F.date_add(last, 1)))  # at most a row for each calendar day
    base = _over_cuts(p, "txn_date", F.col("until"), first, last, history, horizon, step).select("as_of", F.col("position_paise").alias("baseline_paise"))
    later = p.select(F.date_sub("txn_date", horizon).alias("txn_date"), F.date_sub("until", horizon).alias("until"), "position_paise")
    later = _over_cuts(later, "txn_date", F.col("until"), first, last, history, horizon, step).select("as_of", F.col("position_paise").alias("actual_paise"))
    expected = F.col("baseline_paise") + F.col("flow")
    error = F.floor(F.abs(expected - F.col("actual_paise")) * 10000 / F.nullif(F.abs("actual_paise"), F.lit(0))).cast("long")
    return s.join(base, "as_of").join(later, "as_of").select("as_of", "baseline_paise", expected.alias("expected_paise"), (F.col("baseline_paise") + F.col("sure")).alias("conservative_paise"), "actual_paise", error.alias("error_bp"))


def backtest_accuracy(points: DataFrame) -> DataFrame:
    """points and accuracy in basis points: 10000 less the mean error, each counted up to 10000; null below two points."""
    return points.agg(F.count(F.lit(1)).alias("points"), F.when(F.count(F.lit(1)) >= 2, 10000 - F.floor(F.avg(F.least("error_bp", F.lit(10000))))).cast("long").alias("accuracy_bp"))
