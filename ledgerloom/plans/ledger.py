"""A ledger, books and rates derived from the star-schema test tables.

Each has a Spark form and a SQL form that gives equal rows. Money is bigint minor units (paise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Shapes of narrations, by order key modulo their number; {r} is the reference, {p} the party.
SHAPES = [
    "UPI/DR/{r}/{p}/HDFC", "SALARY CREDIT {p}", "ATM CASH WITHDRAWAL {r}", "NEFT CR RENT {p}", "EMI HOME LOAN {p}", "CHEQUE RETURN CHG {r}",
    "INTL POS USD 12.50 {p}", "PENAL INTEREST {r}", "CASH DEP SELF", "IMPS P2P {r} {p}", "REVERSAL OF TXN {r}", "BBPS ELECTRICITY BILL {p}", "UPI/DR/{r}/POKER CLUB",
]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _narration(key: Column, ref: Column, party: Column) -> Column:
    out = F.lit(None)
    for i, s in enumerate(SHAPES):
        out = F.when(key % len(SHAPES) == i, F.replace(F.replace(F.lit(s), F.lit("{r}"), ref), F.lit("{p}"), party)).otherwise(out)
    return out


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ledger rows. Planted by key: three busy days of large equal amounts on account 3 (modulo 149),
    large first debits of new parties (401), rows dated ahead (601) and balances off by 777 (503)."""
    o = read(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    busy, big, ahead, off = key % 149 == 8, key % 401 == 7, key % 601 == 9, key % 503 == 4
    cents = F.when(busy, 200_000_000).otherwise(F.round(F.col("o_totalprice") * 100) * F.when(big, 30).otherwise(1)).cast("long")
    credit = key % 5 < 2
    ref = F.concat(F.lit("REF"), F.lpad(key.cast("string"), 10, "0"))
    party = F.when(big, F.concat(F.lit("VENDOR "), key.cast("string"))).otherwise(F.concat(F.lit("PARTY "), (F.col("o_custkey") % 50).cast("string")))
    day = F.when(busy, F.date_add(F.lit("1997-05-03").cast("date"), (key % 3).cast("int"))).when(ahead, F.lit("2003-01-01").cast("date")).otherwise(F.to_date("o_orderdate"))
    account = F.when(busy, 3).otherwise(F.floor(F.col("o_custkey") / 15)).cast("long")
    t = o.select(
        key.alias("txn_id"), account.alias("account_id"), (account % 4).alias("entity_id"), (account * 100 + F.year(day) - 1995).alias("statement_id"),
        F.when(credit, "credit").otherwise("debit").alias("direction"),
        F.when(~credit, cents).alias("debit_paise"), F.when(credit, cents).alias("credit_paise"),
        day.alias("txn_date"), ref.alias("reference_no"), party.alias("counterparty"), _narration(key, ref, party).alias("narration"), F.when(off, 777).otherwise(0).alias("off"),
    )
    signed = F.coalesce("credit_paise", F.lit(0)) - F.coalesce("debit_paise", F.lit(0))
    order = Window.partitionBy("account_id").orderBy("txn_date", "txn_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t.select(
        *[c for c in t.columns if c != "off"], F.row_number().over(Window.partitionBy("statement_id").orderBy("txn_date", "txn_id")).cast("long").alias("row_index"),
        (F.lit(10**9) + F.sum(signed).over(order) + F.col("off")).cast("long").alias("balance_paise"),
        (F.coalesce("credit_paise", F.lit(0)) + F.coalesce("debit_paise", F.lit(0))).alias("amount_paise"), signed.alias("signed_paise"),
    )


_SHAPE_SQL = " ".join(f"when {i} then replace(replace('{s}', '{{r}}', ref), '{{p}}', party)" for i, s in enumerate(SHAPES))
LEDGER_SQL = f"""
o_ as (select *, o_orderkey % 149 = 8 as busy, o_orderkey % 401 = 7 as big, o_orderkey % 5 < 2 as cr, 'REF' || lpad(o_orderkey::varchar, 10, '0') as ref from orders),
p_ as (select *, (case when busy then 200000000 else round(o_totalprice * 100) * case when big then 30 else 1 end end)::bigint as cents, case when big then 'VENDOR ' || o_orderkey else 'PARTY ' || (o_custkey % 50) end as party,
  case when busy then date '1997-05-03' + (o_orderkey % 3)::int when o_orderkey % 601 = 9 then date '2003-01-01' else o_orderdate::date end as d, case when busy then 3 else o_custkey // 15 end as account from o_),
t_ as (select o_orderkey as txn_id, account::bigint as account_id, (account % 4)::bigint as entity_id, (account * 100 + year(d) - 1995)::bigint as statement_id,
  case when cr then 'credit' else 'debit' end as direction, case when not cr then cents end as debit_paise, case when cr then cents end as credit_paise,
  d as txn_date, ref as reference_no, party as counterparty, case o_orderkey % {len(SHAPES)} {_SHAPE_SQL} end as narration from p_),
txn as (select *, row_number() over (partition by statement_id order by txn_date, txn_id) as row_index,
  (1000000000 + sum(coalesce(credit_paise, 0) - coalesce(debit_paise, 0)) over (partition by account_id order by txn_date, txn_id rows unbounded preceding) + case when txn_id % 503 = 4 then 777 else 0 end)::bigint as balance_paise,
  coalesce(credit_paise, 0) + coalesce(debit_paise, 0) as amount_paise, coalesce(credit_paise, 0) - coalesce(debit_paise, 0) as signed_paise from t_)
"""


def books(txn: DataFrame) -> DataFrame:
    """The company's side: some entries missing, late, off in amount, doubled, or split in two (modulo 211)."""
    key = F.col("txn_id")
    split = key % 211 == 6
    b = txn.where("txn_id % 10 <> 0").select(
        key.alias("book_id"), "account_id", "direction", F.when(key % 10 == 1, F.date_add("txn_date", 3)).otherwise(F.col("txn_date")).alias("entry_date"),
        (F.col("amount_paise") + F.when(key % 10 == 2, 5000).otherwise(0)).alias("amount_paise"), F.when((key % 3 == 0) & ~split, F.col("reference_no")).alias("instrument_no"), F.col("counterparty").alias("party_name"),
    )
    twice = b.where("book_id % 97 = 3").withColumn("book_id", F.col("book_id") + 10**9)
    first = F.floor(F.col("amount_paise") * 2 / 5).cast("long")
    part = F.explode(F.array(F.struct(F.lit(3 * 10**9).alias("k"), first.alias("a")), F.struct(F.lit(4 * 10**9).alias("k"), (F.col("amount_paise") - first).alias("a"))))
    parts = b.where("book_id % 211 = 6").withColumn("x", part).withColumns({"book_id": F.col("book_id") + F.col("x.k"), "amount_paise": F.col("x.a")}).drop("x")
    return b.where("book_id % 211 <> 6").unionByName(twice).unionByName(parts)


BOOKS_SQL = """
b0_ as (select txn_id as book_id, account_id, direction, case when txn_id % 10 = 1 then txn_date + 3 else txn_date end as entry_date,
  amount_paise + case when txn_id % 10 = 2 then 5000 else 0 end as amount_paise, case when txn_id % 3 = 0 and txn_id % 211 <> 6 then reference_no end as instrument_no, counterparty as party_name from txn where txn_id % 10 <> 0),
book as (select * from b0_ where book_id % 211 <> 6 union all select book_id + 1000000000, account_id, direction, entry_date, amount_paise, instrument_no, party_name from b0_ where book_id % 97 = 3
  union all select book_id + 3000000000, account_id, direction, entry_date, amount_paise * 2 // 5, instrument_no, party_name from b0_ where book_id % 211 = 6
  union all select book_id + 4000000000, account_id, direction, entry_date, amount_paise - amount_paise * 2 // 5, instrument_no, party_name from b0_ where book_id % 211 = 6)
"""


def with_copies(txn: DataFrame) -> DataFrame:
    """The ledger with planted copies: alert rows a day later without balance or statement, and rows repeated in their statement."""
    base = txn.select("txn_id", "account_id", F.col("statement_id").cast("long").alias("statement_id"), "direction", "amount_paise", "txn_date", "reference_no", "narration", F.col("balance_paise").alias("balance_paise"), "row_index", F.lit("statement").alias("source_type"))
    copy = base.where("txn_id % 50 = 7").withColumns({"txn_id": F.col("txn_id") + 10**9, "txn_date": F.date_add("txn_date", 1), "statement_id": F.lit(None).cast("long"), "balance_paise": F.lit(None).cast("long"), "source_type": F.lit("email_alert")})
    copy = copy.withColumn("reference_no", F.when(F.col("txn_id") % 100 == 7, F.col("reference_no")))
    again = base.where("txn_id % 70 = 9").withColumns({"txn_id": F.col("txn_id") + 2 * 10**9, "row_index": F.col("row_index") + 100_000})
    return base.unionByName(copy).unionByName(again)


COPIES_SQL = """
c0_ as (select txn_id, account_id, statement_id, direction, amount_paise, txn_date, reference_no, narration, balance_paise, row_index, 'statement' as source_type from txn),
led as (select * from c0_ union all select txn_id + 1000000000, account_id, null, direction, amount_paise, txn_date + 1,
  case when (txn_id + 1000000000) % 100 = 7 then reference_no end, narration, null, row_index, 'email_alert' from c0_ where txn_id % 50 = 7
  union all select txn_id + 2000000000, account_id, statement_id, direction, amount_paise, txn_date, reference_no, narration, balance_paise, row_index + 100000, source_type from c0_ where txn_id % 70 = 9)
"""


def rates(spark: SparkSession) -> DataFrame:
    """US dollar quotes: one for each odd month of 1995 to 2001, some months without."""
    return spark.range(0, 84).where("id % 2 = 0").select(F.lit("USD").alias("code"), F.expr("add_months(date'1995-01-01', cast(id as int))").alias("as_of"), (F.lit(80) + F.col("id") % 12 / 10).cast("decimal(20,8)").alias("inr_per_unit"))


RATES_SQL = "rate as (select 'USD' as code, (date '1995-01-01' + to_months(i::int))::date as as_of, (80 + (i % 12) / 10.0)::decimal(20,8) as inr_per_unit from range(0, 84, 2) r(i))"


def with_transfers(txn: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The ledger with planted transfers to the next account, told by a number or by the account's last digits; and the accounts."""
    key, plain = F.col("txn_id"), F.col("direction") == "debit"
    plain = plain & (F.col("amount_paise") != 200_000_000)
    number = lambda a: F.concat(F.lit("9000"), F.lpad(a.cast("string"), 6, "0"))
    utr, tail = F.concat(F.lit("NEFT UTR"), F.lpad(key.cast("string"), 12, "0")), F.concat(F.lit("IMPS TO XXXX"), F.right(number(F.col("account_id") + 1), F.lit(4)))
    base = txn.select("txn_id", "account_id", "direction", "amount_paise", "txn_date", F.when(plain & (key % 60 == 3), utr).when(plain & (key % 60 == 8), tail).otherwise(F.col("narration")).alias("narration"))
    moved = base.where(plain & (key % 60).isin(3, 8)).withColumns({"txn_id": key + 5 * 10**9, "account_id": F.col("account_id") + 1, "direction": F.lit("credit"), "txn_date": F.date_add("txn_date", 1), "narration": F.when(key % 60 == 3, F.col("narration")).otherwise(F.lit("IMPS IN"))})
    led = base.unionByName(moved)
    return led, led.select("account_id").distinct().select("account_id", number(F.col("account_id")).alias("number"), F.lit(None).cast("string").alias("holder"))


TRANSFERS_SQL = """
tr0_ as (select txn_id, account_id, direction, amount_paise, txn_date, case when direction = 'debit' and amount_paise <> 200000000 then txn_id % 60 end as k, narration as said from txn),
tr_ as (select * exclude (said), case k when 3 then 'NEFT UTR' || lpad(txn_id::varchar, 12, '0') when 8 then 'IMPS TO XXXX' || right('9000' || lpad((account_id + 1)::varchar, 6, '0'), 4) else said end as narration from tr0_),
tled as (select txn_id, account_id, direction, amount_paise, txn_date, narration from tr_ union all select txn_id + 5000000000, account_id + 1, 'credit', amount_paise, txn_date + 1, case when k = 3 then narration else 'IMPS IN' end from tr_ where k in (3, 8))
"""
