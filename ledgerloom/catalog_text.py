"""Queries over alerts, narrations, dates, backtests and decisions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _CAD, _NOM, query
from .functions import narration, text
from .operators import alerts, classify, consolidation, matching, timeseries
from .plans.ledger import BOOKS_SQL, books

_PLAIN = "(amount_paise // 100) || '.' || lpad((amount_paise % 100)::varchar, 2, '0')"


def _plain():
    return F.concat(F.expr("(amount_paise div 100)").cast("string"), F.lit("."), F.lpad((F.col("amount_paise") % 100).cast("string"), 2, "0"))


# ---- alerts


def _messages(t):
    """A message for each ledger row, of six kinds by its key: three payments, a code, a stranger, an offer."""
    k, tail, day = F.col("txn_id") % 6, F.lpad((F.col("account_id") % 10000).cast("string"), 4, "0"), F.date_format("txn_date", "dd-MM-yyyy")
    say = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    kinds = [
        ("Axis <alerts@axisbank.com>", say("INR ", _plain(), " debited from A/c XX", tail, " via UPI on ", day, " to ", F.col("counterparty"), ". Ref No: ", F.col("reference_no"), ". Bal: INR 1,234.50")),
        ("noreply@mail.kotak.com", say("Rs.", _plain(), " credited to Account no ", tail, " by NEFT dated ", day, "; UTR ", F.col("reference_no"))),
        ("noreply@mail.kotak.com", say("Your OTP is 123456 for Rs 10 to be paid")), ("x@shop.example", say("Rs ", _plain(), " debited")),
        ("noreply@yesbank.in", say("Special offer: apply now, Rs 500 received by many")),
        ("card@hdfcbank.net", say("Rs ", _plain(), " spent on Card xx", tail, " at SHOP ", F.col("counterparty"), " on ", day, " before Rs 5 was credited")),
    ]
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) if isinstance(x[i], str) else x[i] for x in kinds]), (k + 1).cast("int"))
    return t.select("txn_id", pick(0).alias("sender"), F.lit("Notice").alias("subject"), pick(1).alias("body"))


_ALERTS = f"""+ m as (select *, txn_id % 6 as k, lpad((account_id % 10000)::varchar, 4, '0') as l4, strftime(txn_date, '%d-%m-%Y') as dt from txn),
f as (select txn_id, k, case k when 0 then 'Axis Bank' when 1 then 'Kotak Mahindra Bank' when 2 then 'Kotak Mahindra Bank' when 4 then 'Yes Bank' when 5 then 'HDFC Bank' end as bank, case k when 2 then 'code' when 3 then 'sender' when 4 then 'offer' else 'alert' end as verdict,
  case when k in (0, 1, 5) then amount_paise end as amount_paise, case when k = 1 then 'credit' when k in (0, 5) then 'debit' end as direction, case when k in (0, 1, 5) then l4 end as last4,
  case k when 0 then 'UPI' when 1 then 'NEFT' end as mode, case k when 0 then counterparty when 5 then 'SHOP ' || counterparty end as party, case when k = 0 then 123450 end::bigint as balance_paise, case when k in (0, 1) then reference_no end as reference_no, case when k in (0, 1, 5) then dt end as day_text from m)
"""


@query(_ALERTS + "select * exclude (k) from f")
def sc33_alert_fields(t, spark, sf_dir):
    return alerts.parse(_messages(t)).drop("sender", "subject", "body", "fingerprint")


@query(_ALERTS + "select verdict, bank, direction, count(*) as n from f group by 1, 2, 3")
def sc32_alert_verdicts(t, spark, sf_dir):
    return alerts.parse(_messages(t)).groupBy("verdict", "bank", "direction").agg(F.count(F.lit(1)).alias("n"))


@query(_ALERTS + "select txn_id, sha256(concat_ws('|', lower(bank), last4, amount_paise::varchar, direction, coalesce(lower(reference_no), 'none'), day_text)) as fingerprint from f where k in (0, 1, 5)")
def sc35_alert_fingerprints(t, spark, sf_dir):
    return alerts.parse(_messages(t)).where("fingerprint is not null").select("txn_id", "fingerprint")


# ---- dates and narrations


@query("select txn_id, case when txn_id % 19 in (17, 18) then make_date(2000, month(txn_date), day(txn_date)) else txn_date end::date as day from txn")
def r5_dates(t, spark, sf_dir):
    formats = [*text.DATE_FORMATS, *text.YEARLESS]
    cell = F.coalesce(*[F.when(F.col("txn_id") % len(formats) == i, F.date_format("txn_date", f)) for i, f in enumerate(formats)])
    return t.select("txn_id", text.date(cell, last_year=2004, this_year=2000).alias("day"))


@query(f"select txn_id, case txn_id % 3 when 0 then 'UPI-BOOKMYSHOW-' || txn_id when 1 then 'Total ' || {_PLAIN} || ' SOS' else narration end as cleaned from txn")
def r8_ocr_clean(t, spark, sf_dir):
    k, zero = F.col("txn_id") % 3, F.translate(_plain(), "015", "OlS")
    # a figure wholly of letters has nothing that says it is a number: it keeps a digit in front
    cell = F.when(k == 0, F.concat(F.lit("  UPI-BOOKMYSHOW-​"), F.col("txn_id").cast("string"))).when(k == 1, F.concat(F.lit("Total \t "), F.when(zero.rlike("[0-9]"), zero).otherwise(_plain()), F.lit(" SOS"))).otherwise(F.col("narration"))
    return t.select("txn_id", narration.ocr_clean(cell).alias("cleaned"))


_LEGS = """+ x as (select txn_id, txn_id % 6 as k, (txn_id % 900 + 100)::bigint as units, amount_paise as booked from txn),
l as (select txn_id, k, case k when 1 then 'JPY' when 4 then 'EUR' else 'USD' end as currency, case k when 0 then units * 100 + 25 when 1 then units when 4 then units * 100 + 50 else units * 100 end as amount_minor,
  case when k = 0 then 88.710000 end::decimal(16,6) as rate, case k when 0 then (units * 100 + 25) * 8871 // 100 else booked end as booked from x where k in (0, 1, 4))
"""


def _legs(t):
    k, units, whole = F.col("txn_id") % 6, (F.col("txn_id") % 900 + 100), (F.col("txn_id") % 900 + 100).cast("string")
    said = [F.concat(F.lit("POS USD "), whole, F.lit(".25 @ 88.71 SHOP")), F.concat(F.lit("shop jpy "), whole), F.concat(F.lit("SWIFT CHARGES USD "), whole, F.lit(".00")), F.concat(F.lit("USD "), whole, F.lit(".00 @ 88.71 OFF")), F.concat(whole, F.lit(".50 EUR MANAGEMENT FEE RECEIPT")), F.concat(F.lit("ZAR "), whole)]
    booked = F.when(k == 0, F.expr("((txn_id % 900 + 100) * 100 + 25) * 8871 div 100")).when(k == 3, units * 100 * 100).otherwise(F.col("amount_paise"))
    return t.select("txn_id", F.element_at(F.array(*said), (k + 1).cast("int")).alias("said"), booked.cast("long").alias("booked")).withColumn("leg", narration.fx_leg(F.col("said"), F.col("booked"))).where("leg is not null")


@query(_LEGS + "select txn_id, currency, amount_minor, rate::double as rate, rate is not null as quoted from l")
def r33_foreign_legs(t, spark, sf_dir):
    return _legs(t).select("txn_id", "leg.currency", "leg.amount_minor", F.col("leg.rate").cast("double").alias("rate"), "leg.quoted")


@query(_LEGS + "select txn_id, round(coalesce(rate::double, booked::double / (amount_minor * case when currency = 'JPY' then 100 else 1 end)), 8) as rate from l")
def r34_effective_rates(t, spark, sf_dir):
    return _legs(t).select("txn_id", narration.effective_rate(F.col("leg"), F.col("booked")).cast("double").alias("rate"))


@query("select txn_id, case when txn_id % 7 in (4, 6) then null else trim(regexp_replace(counterparty, '\\b\\d{5,}\\b', '')) end as party from txn")
def r35_parties(t, spark, sf_dir):
    name = F.col("counterparty")
    said = [("NEFT DR-AXIS0001234-", " PVT LTD-CANARA BA"), ("UPI/DR/123456789012/", "/remark"), ("RTN: IMPS-P2A-0012345678-", "-HDFC"), ("", ""), ("CASH DEP ", ""), ("ACH-DR-TPCAPFRST123-", " NETBANK PAYMENT"), ("INTEREST ON ", "")]
    cell = F.element_at(F.array(*[F.concat(F.lit(a), name, F.lit(b)) for a, b in said]), (F.col("txn_id") % len(said) + 1).cast("int"))
    return t.select("txn_id", narration.party(cell).alias("party"))


# ---- series, payers, decisions


_BACKTEST = f"""+ span as (select min(txn_date) as a, max(txn_date) as z from txn), cut as (select (a + 90 + (30 * i)::int)::date as as_of from span, range(0, 400) r(i) where a + 90 + (30 * i)::int <= z - 30),
h as (select as_of, account_id, direction, counterparty, txn_date, amount_paise, txn_date - lag(txn_date) over w as g, row_number() over (partition by as_of, account_id, direction, counterparty order by txn_date desc, txn_id desc) as back from cut join txn on txn_date <= as_of window w as (partition by as_of, account_id, direction, counterparty order by txn_date, txn_id)),
y as (select as_of, direction, count(*) as n, median(g) as gap, floor(median(case when back <= 10 then amount_paise end))::bigint as m from h group by as_of, account_id, direction, counterparty having count(*) >= 3),
v as (select as_of, n, (30 // (case {_NOM} end)) * m * case when direction = 'credit' then 1 else -1 end as value from y where case {_CAD} end is not null),
s as (select as_of, sum(value)::bigint as flow, coalesce(sum(case when n >= 6 then value end), 0)::bigint as sure from v group by 1),
b as (select d.as_of, d.k, sum(last)::bigint as position from (select c.as_of, c.k, account_id, arg_max(balance_paise, {{'d': txn_date, 't': txn_id}}) as last from (select as_of, 0 as k from cut union all select as_of, 30 from cut) c join txn on txn_date <= c.as_of + c.k group by 1, 2, 3) d group by 1, 2),
pt as (select s.as_of, p.position as baseline_paise, p.position + flow as expected_paise, p.position + sure as conservative_paise, q.position as actual_paise, floor(abs(p.position + flow - q.position) * 10000.0::double / nullif(abs(q.position), 0))::bigint as error_bp from s join b p on p.as_of = s.as_of and p.k = 0 join b q on q.as_of = s.as_of and q.k = 30)
"""


@query(_BACKTEST + "select * from pt")
def t3_backtest(t, spark, sf_dir):
    return timeseries.backtest(t)


@query(_BACKTEST + "select count(*) as points, case when count(*) >= 2 then 10000 - floor(avg(least(error_bp, 10000)))::bigint end as accuracy_bp from pt")
def t3_accuracy(t, spark, sf_dir):
    return timeseries.backtest_accuracy(timeseries.backtest(t))


@query("""+ x as (select account_id, case when txn_id % 7 = 3 then 'EMPLOYER ' || (txn_id % 3) else counterparty end as payer, case when txn_id % 7 = 3 then 5000000 + txn_id % 60000 when contains(narration, 'SALARY') and txn_id % 2 = 0 then 5000000 else amount_paise end as a, contains(narration, 'SALARY') as lab from txn where direction = 'credit'),
s as (select distinct account_id, a as s from x where lab), y as (select account_id, payer, exists (select 1 from s where s.account_id = x.account_id and abs(x.a - s.s) * 100 <= 2 * s.s) as near from x)
select account_id, payer, count(*) as n from y group by 1, 2 having bool_and(near) and count(*) >= 2""")
def c10_salary_payers(t, spark, sf_dir):
    k, said = F.col("txn_id") % 7 == 3, F.col("narration").contains("SALARY")
    paid = F.when(k, 5_000_000 + F.col("txn_id") % 60_000).when(said & (F.col("txn_id") % 2 == 0), 5_000_000).otherwise(F.col("amount_paise"))
    payer = F.when(k, F.concat(F.lit("EMPLOYER "), (F.col("txn_id") % 3).cast("string"))).otherwise(F.col("counterparty"))
    return consolidation.salary_payers(t.withColumns({"amount_paise": paid}), payer, said)


@query(f"""+ {BOOKS_SQL}, c as (select txn_id, book_id from txn t join book b on t.account_id = b.account_id and t.direction = b.direction and t.amount_paise = b.amount_paise and t.txn_date = b.entry_date where t.amount_paise <> 200000000)
select txn_id, book_id from c where not (txn_id % 5 = 1 and book_id in (txn_id, txn_id + 1000000000)) and txn_id % 7 <> 2 and not (book_id % 7 = 2 and book_id < 1000000000)""")
def j5_replayed_decisions(t, spark, sf_dir):
    t = t.where("amount_paise <> 200000000")
    b = books(t)
    same = ["account_id", "direction", "amount_paise"]
    c = t.select(*same, "txn_id", F.col("txn_date").alias("day")).join(b.select(*same, "book_id", F.col("entry_date").alias("day")), [*same, "day"]).select("txn_id", "book_id")
    key = F.col("txn_id")
    rejected = t.where("txn_id % 5 = 1").select(F.array(key).alias("txn_ids"), F.array(key, key + 10**9).alias("book_ids"), F.lit("rejected").alias("status"))
    confirmed = t.where("txn_id % 7 = 2").select(F.array(key).alias("txn_ids"), F.array(key).alias("book_ids"), F.lit("confirmed").alias("status"))
    return matching.replay_decisions(c, rejected.unionByName(confirmed))


@query("select txn_id, txn_date, txn_date < date '1998-01-01' as carried from txn where txn_date >= date '1998-01-01' or txn_id % 9 = 4")
def j4_carried_forward(t, spark, sf_dir):
    items = t.where("txn_id % 9 in (4, 5)").select("txn_id", F.when(F.col("txn_id") % 9 == 5, F.col("txn_date")).alias("resolved_on"))
    return matching.carry_forward(items.unionByName(items), t.select("txn_id", "txn_date"), F.lit("1998-01-01").cast("date"))


@query("""+ d as (select counterparty as party_key, 'Decided ' || length(counterparty) as decided from txn where counterparty like 'PARTY 1%' group by 1), r as (select txn_id, counterparty as party_key, case when txn_id % 3 = 0 then 'Old' end as category, txn_id % 6 = 0 as needs_review from txn),
j as (select r.*, decided, decided is not null and (category is null or needs_review) as take from r left join d using (party_key))
select txn_id, party_key, case when take then decided else category end as category, case when take then false else needs_review end as needs_review, case when take then 'counterparty_memory' end as method, case when take then 0.95 end::double as confidence from j""")
def k22_propagated(t, spark, sf_dir):
    rows = t.select("txn_id", F.col("counterparty").alias("party_key"), F.when(F.col("txn_id") % 3 == 0, "Old").alias("category"), (F.col("txn_id") % 6 == 0).alias("needs_review"), F.lit(None).cast("string").alias("method"), F.lit(None).cast("double").alias("confidence"))
    decided = t.where("counterparty like 'PARTY 1%'").select(F.col("counterparty").alias("party_key")).distinct().withColumn("category", F.concat(F.lit("Decided "), F.length("party_key").cast("string")))
    return classify.propagate(rows, decided)
