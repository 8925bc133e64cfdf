"""Queries over parsing, scopes, validation, consolidation, reconciliation steps, currency and policy, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _PASS_B, _SKELETON, FINDINGS_SQL, TODAY, _cases, query
from .functions import cells, text
from .operators import anomalies, blockers, classify, consolidation, credit, entities, fx, learned, matching, policy, scoping, timeseries, validation
from .plans.ledger import BOOKS_SQL, COPIES_SQL, RATES_SQL, books, rates, read, with_copies
from .plans.scratch import folder
from .sources import ledger_store, statements

_COMPACT = "regexp_replace(upper(coalesce({0}, '')), '[^A-Z0-9]', '', 'g')"


# ---- cells and narrations


@query("""+ c as (select txn_id, (amount_paise // 100)::varchar || '.' || lpad((amount_paise % 100)::varchar, 2, '0') as a, txn_id % 3 as k, amount_paise from txn)
select txn_id, case when k = 2 then amount_paise else -amount_paise end as paise from c""")
def r2_books_paise(t, spark, sf_dir):
    plain = F.concat(F.expr("(amount_paise div 100)").cast("string"), F.lit("."), F.lpad((F.col("amount_paise") % 100).cast("string"), 2, "0"))
    k = F.col("txn_id") % 3
    cell = F.when(k == 0, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 1, F.concat(F.lit("-"), plain, F.lit(" Dr"))).otherwise(F.concat(plain, F.lit(" Cr.")))
    return t.select("txn_id", cells.signed_paise(cell).alias("paise"))


@query("select txn_id, amount_paise::double / 100 as amount from txn")
def r4_major_units(t, spark, sf_dir):
    return t.select("txn_id", cells.major(F.col("amount_paise")).cast("double").alias("amount"))


@query("""select txn_id, case when txn_id % 3 = 0 then null else lpad((case when txn_id % 3 = 1 then txn_id % 12 + 12 * (txn_id % 2) else txn_id % 24 end)::varchar, 2, '0') || ':' || lpad((txn_id % 60)::varchar, 2, '0') || ':00' end as clock from txn""")
def r7_clock(t, spark, sf_dir):
    key, minute = F.col("txn_id"), F.lpad((F.col("txn_id") % 60).cast("string"), 2, "0")
    hour12 = F.when(key % 12 == 0, 12).otherwise(key % 12).cast("string")
    said = F.when(key % 3 == 0, F.lit("PAID AT NOON")).when(key % 3 == 1, F.concat(F.lit("at "), hour12, F.lit(":"), minute, F.when(key % 2 == 1, " PM").otherwise(" am"))).otherwise(F.concat((key % 24).cast("string"), F.lit(":"), minute))
    return t.select("txn_id", cells.clock(said).alias("clock"))


@query("select txn_id, regexp_matches(upper(narration), '(^|[^A-Z])UPI([^A-Z]|$)') as upi from txn")
def r11_is_upi(t, spark, sf_dir):
    return t.select("txn_id", cells.is_upi(F.col("narration")).alias("upi"))


@query("""+ f as (select statement_id, txn_id, row_index, txn_date, case when statement_id % 2 = 1 then -row_index else row_index end as pos from txn),
e as (select statement_id, arg_min(txn_date, pos) as head, arg_max(txn_date, pos) as tail from f group by 1)
select statement_id, txn_id, row_number() over (partition by statement_id order by case when head > tail then -pos else pos end, txn_id) as row_index from f join e using (statement_id)""")
def r15_oldest_first(t, spark, sf_dir):
    file = t.select("statement_id", "txn_id", "txn_date", F.when(F.col("statement_id") % 2 == 1, -F.col("row_index")).otherwise(F.col("row_index")).alias("row_index"))
    return consolidation.oldest_first(file)


@query("""+ k as (select txn_id, amount_paise, unnest(string_split_regex(upper(narration || ' ' || txn_date::varchar || ' ' || amount_paise::varchar), '[^A-Z0-9]+')) as w from txn),
i as (select distinct txn_id, amount_paise, case when regexp_full_match(w, '[0-9]+') then ltrim(w, '0') else w end as id from k where regexp_full_match(w, '[0-9]{6,}') or (regexp_full_match(w, '[A-Z0-9]{10,22}') and length(regexp_replace(w, '[^0-9]', '', 'g')) >= 6))
select t.txn_id, coalesce(string_agg(id, ',' order by id), '') as ids from txn t left join (select * from i where id <> amount_paise::varchar and length(id) >= 6) i using (txn_id) group by 1""")
def r21_strong_ids(t, spark, sf_dir):
    said = F.concat_ws(" ", "narration", F.col("txn_date").cast("string"), F.col("amount_paise").cast("string"))
    return t.select("txn_id", F.array_join(cells.strong_ids(said, F.col("amount_paise")), ",").alias("ids"))


@query("select txn_id, case when txn_id % 2 = 0 then reference_no else ltrim(txn_id::varchar, '0') end as id from txn")
def r22_norm_id(t, spark, sf_dir):
    return t.select("txn_id", cells.norm_id(F.when(F.col("txn_id") % 2 == 0, F.concat_ws("-", F.substring("reference_no", 1, 3), F.expr("lower(substr(reference_no, 4))"))).otherwise(F.lpad(F.col("txn_id").cast("string"), 12, "0"))).alias("id"))


@query(f"""+ k as (select distinct txn_id, unnest(string_split_regex(upper(narration), '[^A-Z]+')) as w from txn) select txn_id, string_agg(w, ',' order by w) as words from k where length(w) >= 4 and w not in ({", ".join(f"'{w}'" for w in matching.STOP_WORDS)}) group by 1""")
def r23_party_words(t, spark, sf_dir):
    return t.select("txn_id", F.array_join(F.sort_array(matching.words("narration")), ",").alias("words")).where("words <> ''")


@query(f"""+ n as (select txn_id, narration as a, case txn_id % 3 when 0 then substr(narration, 1, 12) when 1 then 'OTHER ' || narration else '  ' || lower(narration) || '.' end as b from txn),
c as (select txn_id, a, b, {_COMPACT.format('a')} as x, {_COMPACT.format('b')} as y from n)
select txn_id, x = y or (least(length(x), length(y)) >= 8 and (starts_with(x, y) or starts_with(y, x))) or len(list_intersect(regexp_extract_all(x, '[0-9]{{9,}}'), regexp_extract_all(y, '[0-9]{{9,}}'))) > 0 as same from c""")
def r27_same_narration(t, spark, sf_dir):
    k, n = F.col("txn_id") % 3, F.col("narration")
    other = F.when(k == 0, F.substring(n, 1, 12)).when(k == 1, F.concat(F.lit("OTHER "), n)).otherwise(F.concat(F.lit("  "), F.lower(n), F.lit(".")))
    return t.select("txn_id", cells.same_narration(n, other).alias("same"))


@query(f"""+ k as (select txn_id, list_filter(string_split_regex(upper(narration || ' 12 MAR 99'), '[^A-Z0-9]+'), lambda w: w <> '' and not regexp_matches(w, '[0-9]') and not regexp_full_match(w, '{cells.MONTHS}')) as w from txn) select txn_id, array_to_string(w[1:6], ' ') as shape from k""")
def r37_shape_key(t, spark, sf_dir):
    return t.select("txn_id", cells.shape_key(F.concat(F.col("narration"), F.lit(" 12 MAR 99"))).alias("shape"))


@query(f"""+ s as (select distinct counterparty, {_SKELETON.format("counterparty")} as sk from txn)
select counterparty, case when length(sk) >= 5 then substr(sk, 1, 7) else counterparty end as key from s""")
def r38_group_key(t, spark, sf_dir):
    sk = text.skeleton(F.col("counterparty"))
    return t.select("counterparty").distinct().select("counterparty", F.when(F.length(sk) >= 5, F.substring(sk, 1, 7)).otherwise(F.col("counterparty")).alias("key"))


@query("""select txn_id, round(amount_paise * (0.01::double * pow(1.01::double, 12) / (pow(1.01::double, 12) - 1)))::bigint as emi, round(amount_paise * (1.0::double / 24))::bigint as plain from txn""")
def r47_instalments(t, spark, sf_dir):
    return t.select("txn_id", cells.instalment(F.col("amount_paise"), 12, 12).alias("emi"), cells.instalment(F.col("amount_paise"), 0, 24).alias("plain"))


@query("""select txn_date, (year(txn_date) * 12 + month(txn_date) - 1)::int as month, year(txn_date - interval 3 month) || '-Q' || quarter(txn_date - interval 3 month) as quarter, count(*) as n from txn group by 1""")
def r50_periods(t, spark, sf_dir):
    return t.groupBy("txn_date").agg(F.count(F.lit(1)).alias("n")).select("txn_date", cells.month_ordinal(F.col("txn_date")).alias("month"), cells.fiscal_quarter(F.col("txn_date")).alias("quarter"), "n")


# ---- validation


@query(f"""+ {COPIES_SQL}, d as (select *, row_number() over (partition by statement_id, txn_date, direction, amount_paise, balance_paise, contains(upper(narration), 'UPI'), case when contains(upper(narration), 'UPI') then reference_no else lower(substr(narration, 1, 80)) end order by row_index, txn_id) as k from led where statement_id is not null),
c as (select *, lag(balance_paise) over (partition by statement_id order by txn_date, row_index) as prev, case when direction = 'credit' then amount_paise else -amount_paise end as s from d where k = 1),
g as (select statement_id, count(*) as clean, count(prev) as checked, count(case when abs(balance_paise - prev - s) <= 100 or abs(balance_paise - prev + s) <= 100 then 1 end) as ok from c group by 1),
r as (select statement_id, count(*) as n from d group by 1)
select statement_id, clean, n - clean as rejected, case when checked > 0 then ok * 10000 // checked end as pass_bp, checked > 0 and ok * 100 >= checked * 95 as accepted from g join r using (statement_id)""")
def v1_validate(t, spark, sf_dir):
    return validation.gate(with_copies(t).where("statement_id is not null"))


@query("""select txn_id, case txn_id % 4 when 0 then true when 1 then true when 2 then false else false end as plausible from txn""")
def v3_plausible_dates(t, spark, sf_dir):
    day = F.col("txn_date")
    cell = F.when(F.col("txn_id") % 4 == 0, F.date_format(day, "dd/MM/yyyy")).when(F.col("txn_id") % 4 == 1, F.date_format(day, "yyyy-MM-dd")).when(F.col("txn_id") % 4 == 2, F.lit("31/02/1999")).otherwise(F.lit("12/05/1907"))
    return t.select("txn_id", text.date(cell, last_year=2004).isNotNull().alias("plausible"))


@query("""+ x as (select account_id, abs(balance_paise - signed_paise - lag(balance_paise) over (partition by account_id order by txn_date, txn_id)) as d from txn)
select account_id, count(d) as checkable, count(case when d <= 100 then 1 end) as ok from x group by 1""")
def v8_continuity_by_account(t, spark, sf_dir):
    return validation.canonical_continuity(t)


@query("""+ e as (select unnest([case when txn_date > date '2001-08-03' then 'date_ahead' end, case when debit_paise > 500000000 then 'too_large' end, case when length(narration) < 15 then 'short_narration' end, case when balance_paise < 0 then 'overdrawn' end]) as warning from txn)
select warning, count(*) as n from e where warning is not null group by 1""")
def v10_warning_counts(t, spark, sf_dir):
    codes = {"date_ahead": F.col("txn_date") > F.lit("2001-08-03").cast("date"), "too_large": F.col("debit_paise") > 500_000_000, "short_narration": F.length("narration") < 15, "overdrawn": F.col("balance_paise") < 0}
    return validation.warning_counts(t, codes)


#: A quote for each day of orders from their mean price; every 50th of a kind off by sign, band or step.
_QUOTES = """qd_ as (select o_orderdate::date as as_of, (datediff('day', date '1992-01-01', o_orderdate::date))::bigint as i, count(*) as n from orders group by 1, 2),
quote as (select 'USD' as code, as_of, (case when i % 50 = 7 then -1 when i % 50 = 9 then 2000 when i % 50 in (20, 21) then 95 else 80 + (n % 12) / 10.0 end)::decimal(20,8) as inr_per_unit from qd_)"""


def _quotes(spark, sf_dir):
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("as_of")).agg(F.count(F.lit(1)).alias("n"))
    i = F.datediff("as_of", F.lit("1992-01-01").cast("date"))
    rate = F.when(i % 50 == 7, F.lit(-1)).when(i % 50 == 9, F.lit(2000)).when((i % 50).isin(20, 21), F.lit(95)).otherwise(F.lit(80) + F.col("n") % 12 / 10)
    return days.select(F.lit("USD").alias("code"), "as_of", rate.cast("decimal(20,8)").alias("inr_per_unit"))


@query(f"""+ {_QUOTES}, s as (select *, row_number() over (partition by code order by as_of) as k, inr_per_unit > 0 and inr_per_unit >= 0.0001 and inr_per_unit <= 1000 as fair from quote),
l as (select *, case when fair and inr_per_unit < 90 then inr_per_unit end as taken from s), p as (select *, last_value(taken ignore nulls) over (partition by code order by k rows between unbounded preceding and 1 preceding) as prev from l)
select code, as_of, inr_per_unit::double as inr_per_unit, case when inr_per_unit <= 0 then 'not_positive' when not fair then 'out_of_band' when prev is not null and abs(inr_per_unit - prev) > prev * 0.10 then 'step_too_large' end as reason from p""")
def v13_vet_quotes(t, spark, sf_dir):
    return fx.vet_quotes(_quotes(spark, sf_dir)).withColumn("inr_per_unit", F.col("inr_per_unit").cast("double"))


@query("""select count(*) as n, count(case when debit_paise is null and credit_paise is null then 1 end) as no_side, count(case when amount_paise <= 0 then 1 end) as not_positive,
(count(*) - count(distinct txn_id))::bigint as repeated_ids, (sum(coalesce(credit_paise, 0)) - sum(coalesce(debit_paise, 0)) - sum(signed_paise))::bigint as unbalanced from txn""")
def v15_invariants(t, spark, sf_dir):
    return validation.invariants(t)


# ---- scopes and filters

_ACCOUNTS = "acc as (select distinct account_id, case when account_id % 5 <> 0 then account_id % 4 end as of_entity, account_id % 3 as bank_id from txn)"


def _accounts(t):
    a = F.col("account_id")
    return t.select("account_id").distinct().select("account_id", F.when(a % 5 != 0, a % 4).alias("entity_id"), (a % 3).alias("bank_id"))


@query(f"+ {_ACCOUNTS} select account_id, count(*) as n, sum(amount_paise)::bigint as amount_paise from txn join acc using (account_id) where coalesce(of_entity, entity_id) = 2 and (bank_id = 1 or account_id = 1) group by 1")
def sc2_scoped_rows(t, spark, sf_dir):
    return scoping.in_scope(t, _accounts(t), entity=2, bank=1).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").cast("long").alias("amount_paise"))


@query("select txn_id, account_id, entity_id, txn_date, debit_paise, narration, counterparty, reference_no, statement_id from txn where debit_paise > 0 and (narration ilike '%loan%' or counterparty ilike '%loan%')")
def sc4_outflow_scan(t, spark, sf_dir):
    return scoping.outflows(t, "loan")


_PREDICTED = "pr as (select txn_id, case txn_id % 6 when 0 then null when 1 then 'Uncategorised' else 'Rent' end as category, (txn_id % 10) / 10.0::double as confidence, txn_id % 7 = 0 as manual from txn where txn_id % 4 <> 0)"


def _predicted(t):
    k = F.col("txn_id")
    return t.where(k % 4 != 0).select("txn_id", F.when(k % 6 == 1, "Uncategorised").when(k % 6 > 1, "Rent").alias("category"), ((k % 10) / 10).alias("confidence"), (k % 7 == 0).alias("manual"))


@query(f"""+ {_PREDICTED} select txn_id, counterparty, amount_paise, category, confidence from txn left join pr using (txn_id) where not coalesce(manual, false) and (category is null or category = 'Uncategorised' or coalesce(confidence, 0) < 0.7)""")
def sc5_review_queue(t, spark, sf_dir):
    return scoping.review_queue(t, _predicted(t))


@query(f"+ {_PREDICTED} select coalesce(category, 'none') as category, count(*) as n from pr where not manual and (category is null or category = 'Uncategorised' or confidence < 0.7) group by 1")
def p24_needs_decision(t, spark, sf_dir):
    return _predicted(t).where(scoping.needs_decision()).groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query(f"select 'upi' as kind, count(*) as n from txn where {_cases(classify.RAILS)} = 'upi' union all select 'credit', count(*) from txn where direction = 'credit'")
def p3_of_type(t, spark, sf_dir):
    rail = classify.first_of(F.upper("narration"), classify.RAILS)
    n = lambda k: scoping.of_type(t, k, rail).groupBy().agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n"))
    return n("upi").unionByName(n("credit"))


@query("+ x as (select txn_id, case when txn_id % 9 <> 0 then txn_date end as day from txn) select txn_id, day from x where day is null or day between date '1997-01-01' and date '1997-12-31'")
def p7_null_days_kept(t, spark, sf_dir):
    return scoping.in_period(t.select("txn_id", F.when(F.col("txn_id") % 9 != 0, F.col("txn_date")).alias("day")), "day", "1997-01-01", "1997-12-31")


@query("select statement_id, min(txn_date) as first_date from txn where statement_id in (select statement_id from txn where contains(narration, 'POKER')) group by 1")
def p9_statements_with(t, spark, sf_dir):
    return t.join(t.where(F.contains("narration", F.lit("POKER"))).select("statement_id").distinct(), "statement_id", "left_semi").groupBy("statement_id").agg(F.min("txn_date").alias("first_date"))


@query("+ r as (select statement_id as run, account_id, max(txn_date) as day, statement_id % 3 <> 0 as completed from txn group by 1, 2) select run, account_id, day, lag(run) over (partition by account_id order by day, run) as previous from r where completed")
def p13_previous_run(t, spark, sf_dir):
    runs = t.groupBy(F.col("statement_id").alias("run"), "account_id").agg(F.max("txn_date").alias("day")).withColumn("completed", F.col("run") % 3 != 0)
    return scoping.previous_run(runs, "account_id", "day", "run").drop("completed")


@query("+ k as (select *, row_number() over (partition by account_id, counterparty order by txn_date desc, txn_id desc) as r from txn) select account_id, counterparty, txn_id, narration from k where r = 1")
def p15_last_write(t, spark, sf_dir):
    return scoping.last_write(t, ["account_id", "counterparty"], ["txn_date", "txn_id"]).select("account_id", "counterparty", "txn_id", "narration")


@query("+ o as (select sha256(account_id || '|' || counterparty) as fingerprint from txn where year(txn_date) = 1996 group by account_id, counterparty), n as (select sha256(account_id || '|' || counterparty) as fingerprint from txn where year(txn_date) = 1997 group by account_id, counterparty) select fingerprint from o where fingerprint not in (select fingerprint from n)")
def p18_not_renewed(t, spark, sf_dir):
    of = lambda y: t.where(F.year("txn_date") == y).select("account_id", "counterparty").distinct().select(F.sha2(F.concat_ws("|", "account_id", "counterparty"), 256).alias("fingerprint"))
    return scoping.not_renewed(of(1996), of(1997))


@query("+ a as (select amount_paise, count(*) x from txn where direction = 'debit' group by 1), b as (select amount_paise, count(*) y from txn where direction = 'credit' group by 1) select amount_paise, least(coalesce(x, 0), coalesce(y, 0)) as \"both\", greatest(coalesce(x, 0), coalesce(y, 0)) as either from a full join b using (amount_paise)")
def p20_counter_overlap(t, spark, sf_dir):
    return scoping.counter_overlap(t.where("direction = 'debit'").select("amount_paise"), t.where("direction = 'credit'").select("amount_paise"), "amount_paise")


@query("+ g as (select json_keys(props)[1] as key, min(event_id) as first from events group by 1) select key, row_number() over (order by first, key)::int as place from g where key is not null")
def p22_first_seen_keys(t, spark, sf_dir):
    keys = read(spark, sf_dir, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    return scoping.first_seen(keys, "key", "event_id")


@query("""+ e as (select user_id, event_type, ts, event_id, case when lag(event_type) over w is distinct from event_type then 1 else 0 end as c from events window w as (partition by user_id order by ts, event_id)),
r as (select *, sum(c) over (partition by user_id order by ts, event_id rows unbounded preceding) as run from e), g as (select user_id, run, any_value(event_type) as event_type, count(*) as confirmed from r group by 1, 2)
select user_id, arg_max(event_type, run) as event_type, arg_max(confirmed, run) as confirmed from g group by 1""")
def k19_confirmed_decisions(t, spark, sf_dir):
    return scoping.decisions(read(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("select source, sha256(coalesce(text, '')) as digest, min(doc_id) as kept, count(*) as copies from documents group by 1, 2")
def d8_unique_files(t, spark, sf_dir):
    return scoping.unique_files(read(spark, sf_dir, "documents"), "source", "doc_id", "text")


@query("""select txn_id, regexp_matches(narration, '(^|[^A-Z0-9])LOAN([^A-Z0-9]|$)') as word, contains(narration, 'LOAN') as inside from txn""")
def k3_word_and_inside(t, spark, sf_dir):
    return t.select("txn_id", F.col("narration").rlike("(^|[^A-Z0-9])LOAN([^A-Z0-9]|$)").alias("word"), F.contains("narration", F.lit("LOAN")).alias("inside"))


# ---- files


@query("""select 'T' || txn_id || ' ' || narration || case when txn_id % 9 = 4 then ' and more' else '' end as narration, txn_date, direction, amount_paise from txn""")
def sc9_mixed_files(t, spark, sf_dir):
    """The ledger written as CSV files of three layouts and separators below one folder, some narrations over two lines, read back by the files' own headers."""
    path = folder(spark, "mixed-files")
    plain = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%d.%02d", F.expr(f"{c} div 100"), F.expr(f"{c} % 100")))
    signed = F.concat(F.when(F.col("direction") == "debit", "-").otherwise(""), plain("amount_paise"))
    none = F.lit(None).cast("string")
    told = F.struct(F.date_format("txn_date", "dd/MM/yyyy").alias("Date"), F.concat(F.lit("T"), "txn_id", F.lit(" "), "narration").alias("Narration"), plain("debit_paise").alias("Debit"), plain("credit_paise").alias("Credit"), signed.alias("Amount"))
    more = F.struct(none.alias("Date"), F.lit("and more").alias("Narration"), none.alias("Debit"), none.alias("Credit"), none.alias("Amount"))
    lines = t.select("txn_id", F.explode(F.when(F.col("txn_id") % 9 == 4, F.array(told, more)).otherwise(F.array(told))).alias("x")).select("txn_id", "x.*")
    for k, (cols, sep) in enumerate([(("Date", "Narration", "Debit", "Credit"), ","), (("Date", "Credit", "Narration", "Debit"), ","), (("Narration", "Date", "Amount"), ";")]):
        lines.where(F.col("txn_id") % 3 == k).select(*cols).write.csv(f"{path}/{k}", header=True, sep=sep)
    return statements.typed(statements.read_delimited(spark, f"{path}/*")).select("narration", "txn_date", "direction", "amount_paise")


# ---- consolidation

_FILES = """f1 as (select statement_id * 2 as file_id, account_id, txn_date, row_index, direction, amount_paise, balance_paise, narration from txn where txn_id % 7 <> 3 or month(txn_date) < 7),
f2 as (select statement_id * 2 + 1 as file_id, account_id, txn_date, row_index + 7 as row_index, direction, amount_paise, balance_paise, substr(narration, 1, 14) as narration from txn where month(txn_date) >= 7),
f3 as (select 1000000 + statement_id as file_id, account_id, txn_date, row_index, direction, amount_paise, balance_paise, substr(narration, 1, 10) || ' SOMEONE ELSE' as narration from txn where txn_id % 40 = 11),
k1 as (select *, regexp_replace(upper(narration), '[^A-Z0-9]', '', 'g') as said from f1), k2 as (select *, regexp_replace(upper(narration), '[^A-Z0-9]', '', 'g') as said from f2),
m2 as (select k2.*, k1.file_id as of_file from k2 left join k1 on k1.account_id = k2.account_id and k1.txn_date = k2.txn_date and k1.direction = k2.direction and k1.amount_paise = k2.amount_paise and k1.balance_paise = k2.balance_paise
  and k1.file_id <> k2.file_id and ((starts_with(k1.said, k2.said) and length(k2.said) >= 8) or k1.said = k2.said)),
merged12 as (select k1.account_id, k1.txn_date, k1.file_id, k1.row_index, k1.direction, k1.amount_paise, k1.balance_paise, k1.narration, (1 + (m2.file_id is not null)::int)::bigint as sources, m2.file_id as also
    from k1 left join m2 on m2.of_file = k1.file_id and m2.txn_date = k1.txn_date and m2.direction = k1.direction and m2.amount_paise = k1.amount_paise and m2.balance_paise = k1.balance_paise
  union all select account_id, txn_date, file_id, row_index, direction, amount_paise, balance_paise, narration, 1, null from m2 where of_file is null)"""


def _files(t, third=False):
    """Statements, second ones of each year's end that have all rows with cut narrations, and look-alikes of other parties."""
    cols = ["account_id", "txn_date", "row_index", "direction", "amount_paise", "balance_paise", "narration"]
    first = t.where("txn_id % 7 <> 3 or month(txn_date) < 7").select((F.col("statement_id") * 2).alias("file_id"), *cols)
    second = t.where(F.month("txn_date") >= 7).select((F.col("statement_id") * 2 + 1).alias("file_id"), *cols).withColumns({"row_index": F.col("row_index") + 7, "narration": F.substring("narration", 1, 14)})
    other = t.where("txn_id % 40 = 11").select((F.col("statement_id") + 1_000_000).alias("file_id"), *cols).withColumn("narration", F.concat(F.substring("narration", 1, 10), F.lit(" SOMEONE ELSE")))
    return first.unionByName(second).unionByName(other) if third else first.unionByName(second)


@query(f"+ {_FILES} select * exclude (also) from merged12 union all select account_id, txn_date, file_id, row_index, direction, amount_paise, balance_paise, narration, 1 from f3")
def c1_merge_statements(t, spark, sf_dir):
    return consolidation.merge_statements(_files(t, third=True)).drop("lineage")


#: The later file has every row of its months, so that its own order is the order of a day.
_PLACED = "placed as (select m.*, row_number() over (partition by account_id order by txn_date, case when file_id % 2 = 1 then row_index - 7 else row_index end) as place from merged12 m)"


@query(f"+ {_FILES}, {_PLACED} select account_id, file_id, row_index, place from placed")
def c2_in_file_order(t, spark, sf_dir):
    return consolidation.in_file_order(consolidation.merge_statements(_files(t))).select("account_id", "file_id", "row_index", "place")


@query(f"""+ {_FILES}, {_PLACED}, x as (select *, lag(balance_paise) over o as pb, lag(file_id) over o as pf, lag(also) over o as pa, case when direction = 'credit' then amount_paise else -amount_paise end as s from placed window o as (partition by account_id order by place))
select account_id, file_id, row_index, case when coalesce(pf in (file_id, also), false) or coalesce(pa in (file_id, also), false) then 'within_statement' else 'between_statements' end as kind, (balance_paise - pb - s)::bigint as diff_paise from x where balance_paise - pb - s <> 0""")
def c3_balance_flags(t, spark, sf_dir):
    return consolidation.balance_flags(consolidation.in_file_order(consolidation.merge_statements(_files(t))), ["place"])


@query("""+ f as (select statement_id as file_id, arg_min(balance_paise, row_index) as b, arg_min(signed_paise, row_index) as s from txn group by 1),
o as (select *, case when file_id % 11 <> 4 then b - s + case when file_id % 3 = 0 then 150 else 0 end end as opening_paise from f)
select file_id, opening_paise::bigint as opening_paise, (opening_paise + s)::bigint as expected_paise, b as balance_paise, (b - opening_paise - s)::bigint as diff_paise from o where opening_paise + s <> b""")
def c5_opening_flags(t, spark, sf_dir):
    rows = t.withColumn("file_id", F.col("statement_id"))
    first = rows.groupBy("file_id").agg(F.min_by(F.col("balance_paise") - F.col("signed_paise"), "row_index").alias("o"))
    printed = first.select("file_id", F.when(F.col("file_id") % 11 != 4, F.col("o") + F.when(F.col("file_id") % 3 == 0, 150).otherwise(0)).alias("opening_paise"))
    return consolidation.opening_flags(printed, rows)


@query("+ s as (select statement_id as file_id, account_id, case when statement_id % 4 = 1 then 'BANK ' || (statement_id % 3) end as bank from txn group by 1, 2), k as (select account_id, arg_min(bank, file_id) as known from s where bank is not null group by 1) select file_id, account_id, coalesce(bank, known) as bank from s left join k using (account_id)")
def c13_fill_bank(t, spark, sf_dir):
    s = t.select(F.col("statement_id").alias("file_id"), "account_id").distinct()
    return consolidation.fill_bank(s.withColumn("bank", F.when(F.col("file_id") % 4 == 1, F.concat(F.lit("BANK "), (F.col("file_id") % 3).cast("string")))))


@query("""select account_id, count(*) as n, min(txn_date) as first_date, max(txn_date) as last_date, coalesce(sum(credit_paise), 0)::bigint as in_paise, coalesce(sum(debit_paise), 0)::bigint as out_paise,
arg_min(balance_paise, {'d': txn_date, 't': txn_id}) as first_balance, arg_max(balance_paise, {'d': txn_date, 't': txn_id}) as last_balance from txn group by 1""")
def c14_account_summaries(t, spark, sf_dir):
    return consolidation.account_summaries(t, F.struct("txn_date", "txn_id"))


# ---- steps of a reconciliation


@query("""+ a as (select account_id, case when account_id % 5 = 0 then account_id * 100 end as typed, case when account_id % 3 = 0 then 7 end as batch, case when account_id % 2 = 0 then 11 end as prev, account_id % 4 as gap, case when account_id % 7 <> 0 then 13 end as file from txn group by 1)
select account_id, coalesce(typed, batch, case when gap = 1 then prev end, file)::bigint as opening_paise, case when typed is not null then 'manual' when batch is not null then 'batch' when gap = 1 and prev is not null then 'previous_run' when file is not null then 'file' else 'missing' end as basis from a""")
def j3_openings(t, spark, sf_dir):
    k = F.col("account_id")
    day = F.lit("2001-01-31").cast("date")
    a = t.select("account_id").distinct().select("account_id", F.when(k % 5 == 0, k * 100).alias("typed_paise"), F.when(k % 3 == 0, F.lit(7).cast("long")).alias("batch_paise"), F.when(k % 2 == 0, F.lit(11).cast("long")).alias("previous_paise"), day.alias("previous_to"), F.date_add(day, (k % 4).cast("int")).alias("period_from"), F.when(k % 7 != 0, F.lit(13).cast("long")).alias("file_paise"))
    return consolidation.openings(a)


_PASS_A = f"""{BOOKS_SQL}, ma as (select book_id, txn_id from (select b.book_id, t.txn_id, row_number() over (partition by t.txn_id order by entry_date, b.book_id) as r from book b join txn t on b.account_id = t.account_id and b.direction = t.direction and b.amount_paise = t.amount_paise and b.instrument_no = t.reference_no where abs(entry_date - txn_date) <= 90) where r = 1)"""


@query(f"+ {_PASS_A} select * from ma")
def j8_shared_id(t, spark, sf_dir):
    return matching.shared_id(books(t), t)


@query(f"""+ {BOOKS_SQL} select 'book' as side, book_id as id, case when direction = 'credit' then amount_paise else -amount_paise end as signed_paise, coalesce(instrument_no, '') as ref from book
union all select 'bank', txn_id, signed_paise, reference_no from txn""")
def j6_views(t, spark, sf_dir):
    signed = F.when(F.col("direction") == "credit", F.col("amount_paise")).otherwise(-F.col("amount_paise")).alias("signed_paise")
    b = books(t).select(F.lit("book").alias("side"), F.col("book_id").alias("id"), signed, cells.norm_id(F.col("instrument_no")).alias("ref"))
    return b.unionByName(t.select(F.lit("bank").alias("side"), F.col("txn_id").alias("id"), signed, cells.norm_id(F.col("reference_no")).alias("ref")))


def _like(words, padded="' ' || upper(narration) || ' '"):
    return "(" + " or ".join(f"contains({padded}, '{w}')" for w in words) + ")"


@query(f"""select txn_id, case when direction = 'credit' then case when {_like(matching.INTEREST_WORDS)} then 'interest_credit' when {_like(matching.RETURN_WORDS)} then 'dishonoured_cheque' when {_like(matching.CREDIT_RAILS)} then 'direct_credit' else 'unmatched' end
when {_like(matching.RETURN_WORDS)} then 'dishonoured_cheque' when {_like(matching.CHARGE_WORDS)} then 'bank_charge' when {_like(matching.STANDING_WORDS)} then 'standing_instruction' else 'unmatched' end as item from txn""")
def j16_bank_items(t, spark, sf_dir):
    return t.select("txn_id", matching.bank_item().alias("item"))


@query(f"""+ {_PASS_B}, s as (select account_id, sum(case when direction = 'credit' then amount_paise else -amount_paise end)::bigint + 1000000000 as book_closing,
  sum(case when book_id not in (select book_id from m) then case when direction = 'credit' then amount_paise else -amount_paise end else 0 end)::bigint as open_book from book group by 1),
b as (select account_id, arg_max(balance_paise, {{'d': txn_date, 't': txn_id}}) as bank_closing, sum(case when txn_id not in (select txn_id from m) then signed_paise else 0 end)::bigint as open_bank from txn group by 1),
x as (select account_id, book_closing, bank_closing, open_book, open_bank, (bank_closing - (book_closing - open_book + open_bank))::bigint as residual_paise from s join b using (account_id))
select *, case when residual_paise <> 0 then 'unreconciled' else 'reconciled' end as verdict from x""")
def j17_verdicts(t, spark, sf_dir):
    b = books(t)
    return matching.verdicts(b, t, matching.same_day(b, t), t.select("account_id").distinct().withColumn("opening_paise", F.lit(10**9).cast("long")))


@query()
def j12_groups(t, spark, sf_dir):
    b = books(t)
    m = matching.same_day(b, t)
    return matching.group_matches(t.join(m, "txn_id", "left_anti"), "txn_id", "txn_date", b.join(m, "book_id", "left_anti"), "book_id", "entry_date")


@query()
def j14_suggestions(t, spark, sf_dir):
    b = books(t)
    m = matching.same_day(b, t)
    return matching.suggestions(b.join(m, "book_id", "left_anti"), t.join(m, "txn_id", "left_anti"))


# ---- before a run, and what is written


@query("""+ s as (select account_id, min(txn_date) as f, max(txn_date) as u, statement_id % 4 <> 1 as ok from txn group by statement_id, account_id),
r as (select account_id * 100 + i as run_id, account_id, (date '1996-01-15' + to_months(4 * i::int))::date as f, (date '1996-01-15' + to_months(4 * i::int + 3))::date as u, account_id % 6 = 5 as force from (select distinct account_id from txn) a, range(0, 15) t(i)),
d as (select account_id, count(*) as pending from txn where txn_id % 400 = 7 group by 1)
select run_id, count(s.account_id) as unreconciled, coalesce(any_value(pending), 0)::bigint as pending, not any_value(force) and count(s.account_id) + coalesce(any_value(pending), 0) > 0 as blocked
from r left join s on s.account_id = r.account_id and not s.ok and s.f <= r.u and s.u >= r.f left join d on d.account_id = r.account_id group by run_id""")
def j1_preflight(t, spark, sf_dir):
    statements_ = t.groupBy("statement_id", "account_id").agg(F.min("txn_date").alias("period_from"), F.max("txn_date").alias("period_to")).withColumn("reconciled", F.col("statement_id") % 4 != 1)
    start = lambda extra: F.add_months(F.lit("1996-01-15").cast("date"), F.col("i") * 4 + extra)
    runs = t.select("account_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(14))))
    runs = runs.select((F.col("account_id") * 100 + F.col("i")).alias("run_id"), "account_id", start(0).alias("period_from"), start(3).alias("period_to"), (F.col("account_id") % 6 == 5).alias("force"))
    return blockers.preflight(runs, statements_, t.where("txn_id % 400 = 7"))


@query("""select txn_id, statement_id, case when statement_id % 5 = 0 then 'AGAIN ' || narration else narration end as narration, case when statement_id % 5 = 0 then 'second' else 'first' end as written_by
from txn where not (statement_id % 5 = 0 and txn_id % 3 = 0) and statement_id % 50 <> 7""")
def sk3_replace_statements(t, spark, sf_dir):
    """The ledger written, every fifth statement parsed again with fewer rows (twice), and some parsed to nothing."""
    path = folder(spark, "ledger")
    ledger_store.replace_statements(ledger_store.canonical(t, "first"), path, buckets=8)
    again = t.where("statement_id % 5 = 0 and txn_id % 3 <> 0").withColumn("narration", F.concat(F.lit("AGAIN "), "narration"))
    gone = t.where("statement_id % 5 = 0 or statement_id % 50 = 7").select("statement_id").distinct()
    for _ in range(2):
        ledger_store.replace_statements(ledger_store.canonical(again, "second"), path, gone, buckets=8)
    return ledger_store.read_ledger(spark, path).select("txn_id", "statement_id", "narration", "written_by")


# ---- the learned category model


_MODEL_SIDES = """s as (select txn_id, case when txn_id % 7 > 0 then 'C' || txn_id % 3 end as rule_category, case txn_id % 7 when 0 then 0 when 1 then 40 when 2 then 50 when 3 then 79 when 4 then 80 when 5 then 99 else 110 end as rule_score, txn_id % 11 = 0 as rule_ambiguous,
  case when txn_id % 13 > 0 then 'C' || txn_id % 2 end as ml_category, case when txn_id % 13 > 0 then (txn_id % 17) / 16.0::double end as ml_confidence, txn_id % 5 as known_words, 4 as told_words from txn)"""


@query(f"""+ {_MODEL_SIDES}, f as (select *, ml_category is not null and known_words >= 2 as ok, rule_category is not null and rule_score >= 80 and not rule_ambiguous as high, coalesce(rule_category is not null and rule_score between 50 and 79, false) as med, coalesce(rule_category = ml_category, false) as same from s),
g as (select *, ok and ml_confidence >= 0.70 as acc, ok and ml_confidence >= 0.85 as strong from f),
m as (select *, case when high and same then 'hybrid' when high and strong and rule_score < 100 then 'unresolved' when high then 'rule' when med and same and acc then 'hybrid' when med and strong then 'ml' when med then 'unresolved' when acc then 'ml' else 'unresolved' end as method from g)
select txn_id, method, case method when 'hybrid' then rule_category when 'rule' then rule_category when 'ml' then ml_category end as category,
case method when 'hybrid' then greatest(round(least(rule_score / 110.0::double, 0.99), 4), ml_confidence) when 'rule' then round(least(rule_score / 110.0::double, 0.99), 4) when 'ml' then ml_confidence end as confidence, method = 'unresolved' as needs_review from m""")
def k5_hybrid_decision(t, spark, sf_dir):
    k = F.col("txn_id")
    named = lambda n: F.concat(F.lit("C"), (k % n).cast("string"))
    score = F.element_at(F.array(*map(F.lit, (0, 40, 50, 79, 80, 99, 110))), (k % 7 + 1).cast("int"))
    said = (k % 13) > 0
    x = t.select("txn_id", F.when(k % 7 > 0, named(3)).alias("rule_category"), score.alias("rule_score"), (k % 11 == 0).alias("rule_ambiguous"), F.when(said, named(2)).alias("ml_category"), F.when(said, k % 17 / 16).alias("ml_confidence"), (k % 5).alias("known_words"), F.lit(4).alias("told_words"))
    return learned.decide(x).select("txn_id", "method", "category", "confidence", "needs_review")


@query()
def k4_learned_categories(t, spark, sf_dir):
    """Categories learned from the ledger's own flow words on three templates in four, predicted for every row."""
    flows = classify.described(t).withColumnRenamed("flow", "category")
    model = learned.fit(flows.where(~learned.held_out(learned.template(F.col("narration")), 1, 25)))
    return model.predict(flows).select("txn_id", "category", "ml_category", F.round("ml_confidence", 6).alias("ml_confidence"), "known_words", "told_words")


# ---- currency


@query(f"""+ {RATES_SQL}, x as (select txn_id, amount_paise, case when txn_id % 9 <> 0 then txn_date when txn_id % 18 = 0 then date '1985-01-01' end as d from txn),
v as (select *, case when lag(as_of) over (order by as_of) is null then date '0001-01-01' else as_of end as f, coalesce(lead(as_of) over (order by as_of), date '9999-12-31') as e from rate)
select txn_id, inr_per_unit::double as inr_per_unit from x join v on coalesce(d, date '9999-12-30') >= f and coalesce(d, date '9999-12-30') < e""")
def x2_rates_of_all_dates(t, spark, sf_dir):
    k = F.col("txn_id")
    x = t.withColumn("txn_date", F.when(k % 9 != 0, F.col("txn_date")).when(k % 18 == 0, F.lit("1985-01-01").cast("date")))
    return fx.with_rate(x, rates(spark), "USD").select("txn_id", F.col("inr_per_unit").cast("double").alias("inr_per_unit"))


@query(f"""+ {_QUOTES}, s as (select code, as_of, inr_per_unit, case when day(as_of) % 2 = 0 then 'manual' else 'market' end as source from quote where inr_per_unit > 0 and inr_per_unit < 1000), n as (select code, as_of, inr_per_unit + 1 as inr_per_unit, case when day(as_of) % 3 = 0 then 'official' else 'market' end as source from s where month(as_of) < 6),
b as (select *, 1 as age from s union all select *, 0 from n), r as (select *, row_number() over (partition by code, as_of order by case source when 'manual' then 1 when 'official' then 2 else 3 end, age, inr_per_unit) as k from b)
select code, as_of, inr_per_unit::double as inr_per_unit, source from r where k = 1""")
def sk6_upsert_quotes(t, spark, sf_dir):
    day = F.dayofmonth("as_of")
    s = _quotes(spark, sf_dir).where("inr_per_unit > 0 and inr_per_unit < 1000").withColumn("source", F.when(day % 2 == 0, "manual").otherwise("market"))
    n = s.where(F.month("as_of") < 6).withColumns({"inr_per_unit": (F.col("inr_per_unit") + 1).cast("decimal(20,8)"), "source": F.when(day % 3 == 0, "official").otherwise("market")})
    return fx.upsert_quotes(s, n, ("manual", "official", "market")).withColumn("inr_per_unit", F.col("inr_per_unit").cast("double"))


@query("""+ e as (select o_orderdate::date as as_of, 88 + count(*) % 7 as inr, 1 + (count(*) % 5) / 8.0::double as usd from orders group by 1) select 'USD' as code, as_of, round(inr / usd, 8)::double as inr_per_unit from e""")
def x10_cross_rates(t, spark, sf_dir):
    days = read(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("as_of")).agg(F.count(F.lit(1)).alias("n"))
    e = days.select("as_of", F.explode(F.array(F.struct(F.lit("INR").alias("code"), (88 + F.col("n") % 7).cast("double").alias("rate")), F.struct(F.lit("USD").alias("code"), (1 + F.col("n") % 5 / 8).cast("double").alias("rate")))).alias("x")).select("as_of", "x.*")
    return fx.cross_rates(e)


# ---- policies and findings

_SCOPE = {"debit": "debit_paise > 0", "credit": "credit_paise > 0", "any": "true"}


def _applies(r):
    c = _SCOPE[r.scope]
    if r.words:
        c += f" and regexp_matches(lower(narration), '{r.words}')"
    if r.cash:
        c += f" and regexp_matches(upper(narration), '{anomalies.pattern(anomalies.KEYWORDS['cash_withdrawal'][1])}|CASH DEP|BY CASH')"
    return c


_RULES = [*policy.DEFAULT, policy.Rule("cash_receipt", 2 * anomalies.LAKH, "high", scope="credit", cash=True), policy.Rule("large_rent", 2 * anomalies.LAKH, "medium", scope="any", words="rent|loan"), policy.Rule("weekend_payment", 0, "low", weekend=True)]
_BROKEN = " union all ".join(f"select '{r.code}' as code, '{r.severity}' as severity, account_id, txn_id, amount_paise from txn where {_applies(r)} and amount_paise >= {r.limit_paise}" + (" and isodow(txn_date) >= 6" if r.weekend else "") for r in _RULES)


@query(_BROKEN)
def a20_violations(t, spark, sf_dir):
    return policy.violations(t, _RULES)


@query("+ x as (" + " union all ".join(f"select '{r.code}' as code, count(case when {_applies(r)} then 1 end) as applicable, count(case when {_applies(r)} and amount_paise >= {r.limit_paise}" + (" and isodow(txn_date) >= 6" if r.weekend else "") + " then 1 end) as violations from txn" for r in policy.DEFAULT) + ") select *, case when applicable > 0 then (applicable - violations) * 10000 // applicable end as pass_bp from x")
def a27_default_rules(t, spark, sf_dir):
    return policy.evaluate(t, policy.DEFAULT)


@query(_BROKEN.split(" union all ")[-1].replace("select 'weekend_payment' as code, 'low' as severity,", "select"))
def a24_weekend_payments(t, spark, sf_dir):
    return policy.violations(t, [_RULES[-1]]).drop("code", "severity")


@query(_BROKEN.split(" union all ")[-3].replace("select 'cash_receipt' as code, 'high' as severity,", "select"))
def a18_cash_receipts(t, spark, sf_dir):
    return policy.violations(t, [_RULES[-3]]).drop("code", "severity")


@query(FINDINGS_SQL + ", fd as (select distinct * from found) select kind, severity, account_id, txn_id, amount_paise from fd order by case severity when 'critical' then 1 when 'high' then 2 when 'medium' then 3 else 4 end, amount_paise desc nulls last, kind, txn_id limit 200")
def a30_ranked_findings(t, spark, sf_dir):
    return policy.ranked_findings(anomalies.detect_all(t, TODAY), 200)


@query("select txn_id, account_id, amount_paise from txn where contains(upper(narration), 'POKER')")
def a9_risky_merchants(t, spark, sf_dir):
    return anomalies.detect_all(t, TODAY).where("kind = 'risky_merchant'").select("txn_id", "account_id", "amount_paise")


@query("select txn_id, account_id, amount_paise from txn where contains(upper(narration), 'PENAL INTEREST') and debit_paise > 0")
def a13_penal_interest(t, spark, sf_dir):
    return anomalies.detect_all(t, TODAY).where("kind = 'penal_interest'").select("txn_id", "account_id", "amount_paise")


# ---- series and blocks


@query("""+ m as (select account_id, date_trunc('month', txn_date)::date as month, coalesce(sum(credit_paise), 0)::bigint as i, coalesce(sum(debit_paise), 0)::bigint as o from txn group by 1, 2),
g as (select account_id, sum(i)::bigint as in_paise, sum(o)::bigint as out_paise, count(*) as months, count(case when i >= o then 1 end) as surplus_months from m group by 1), l as (select account_id, arg_max(balance_paise, {'d': txn_date, 't': txn_id}) as closing from txn group by 1)
select account_id, in_paise, out_paise, in_paise - out_paise as net_paise, months, surplus_months, case when in_paise > 0 then ((in_paise - out_paise)::hugeint * 10000 // in_paise)::bigint end as savings_bp, case when out_paise > 0 and closing > 0 then (closing::hugeint * months * 30 // out_paise)::bigint end as runway_days from g join l using (account_id)""")
def t11_cash_flow(t, spark, sf_dir):
    return credit.cash_flow(t)


@query("""+ x as (select account_id, statement_id, arg_min(balance_paise - signed_paise, row_index) as first_open, arg_max(balance_paise, row_index) as last_close, sum(signed_paise)::bigint as moved from txn group by 1, 2), s as (select *, case when statement_id % 3 = 0 then first_open end as printed from x)
select statement_id, coalesce(printed, lag(last_close) over (partition by account_id order by statement_id), first_open)::bigint as opening_paise, case when printed is not null then 'reported' when lag(last_close) over (partition by account_id order by statement_id) is not null then 'movement' else 'reconstructed' end as basis from s""")
def t7_openings(t, spark, sf_dir):
    return timeseries.statement_openings(t, F.when(F.col("statement_id") % 3 == 0, F.col("first_open")))


@query("""+ g as (select direction, counterparty, count(distinct date_trunc('month', txn_date)) as months, count(*) as n, min(amount_paise) as low, max(amount_paise) as high from txn group by 1, 2) select * from g where months >= 3""")
def t9_series_members(t, spark, sf_dir):
    return timeseries.series_members(t, "counterparty", 3)


@query("""+ x as (select account_id, abs(balance_paise - signed_paise - lag(balance_paise) over (partition by account_id order by txn_date, txn_id)) as d, counterparty <> 'PARTY 7' as known, balance_paise is not null as read from txn),
g as (select account_id, count(case when read then 1 end) * 10000 // count(*) as parse_bp, case when count(d) > 0 then count(case when d <= 100 then 1 end) * 10000 // count(d) else 0 end as continuity_bp, count(case when known then 1 end) * 10000 // count(*) as coverage_bp from x group by 1)
select *, (2 * parse_bp + continuity_bp + coverage_bp) // 4 as confidence_bp from g""")
def t19_confidence(t, spark, sf_dir):
    return credit.overall_confidence(t, F.col("counterparty") != "PARTY 7")


@query("""+ n as (select c_custkey as id, c_mktsegment || case c_custkey % 3 when 0 then '' when 1 then ' LTD' else ' Ltd' end as name, c_nationkey as cluster from customer), k as (select cluster, name, count(*) as n from n group by 1, 2)
select cluster, arg_min(name, {'n': -n, 'l': -length(name), 'm': name}) as name, count(*) - 1 as aliases from k group by 1""")
def e11_canonical_names(t, spark, sf_dir):
    c, k = read(spark, sf_dir, "customer"), F.col("c_custkey") % 3
    names = c.select(F.col("c_custkey").alias("id"), F.concat("c_mktsegment", F.when(k == 0, "").when(k == 1, " LTD").otherwise(" Ltd")).alias("name"))
    return entities.canonical(names, c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster")))
