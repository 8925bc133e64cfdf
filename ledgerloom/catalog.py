"""All queries of the library with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text
from .operators import anomalies, classify, credit, dashboards, entities, fx, matching, reports, similarity, timeseries, tree, validation
from .plans.ledger import BOOKS_SQL, COPIES_SQL, LEDGER_SQL, RATES_SQL, TRANSFERS_SQL, books, ledger, rates, read, with_copies, with_transfers
from .streaming import metering

TODAY = "2001-08-01"
RULES = {
    "default_category": "Other",
    "rules": [
        {"id": "r-salary", "category": "Income", "priority": 50, "match": {"any_of": ["salary"], "direction": "credit"}},
        {"id": "r-home", "category": "Housing", "priority": 40, "match": {"any_of": ["rent", "home loan"], "none_of": ["reversal"]}},
        {"id": "r-bank", "category": "Charges", "priority": 30, "match": {"regex": "CHARGES|PENAL"}},
        {"id": "r-large", "category": "Large", "priority": 45, "match": {"min_amount": 40000000}},
        {"id": "r-never", "category": "Never", "priority": 99, "match": {"all_of": ["upi", "atm"]}},
    ],
}
WORDS = [("SALARY", "Income", 110), ("RENT", "Housing", 100), ("LOAN", "Loan", 90), ("EMI", "Loan", 80), ("HOME", "Housing", 60), ("CHARGES", "Charges", 80), ("PENAL", "Charges", 100), ("INTEREST", "Interest", 100), ("ATM", "Cash", 100), ("CASH", "Cash", 60), ("ELECTRICITY", "Utilities", 100), ("UPI", "Transfer", 20)]

_Q: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = LEDGER_SQL):
    """Register a query of (txn, spark, sf_dir) with its SQL over the ledger."""

    def put(f):
        _Q[f.__name__] = lambda spark, sf_dir, f=f: f(ledger(spark, sf_dir), spark, sf_dir)
        if sql:
            _SQL[f.__name__] = f"with {base}{',' if sql.lstrip().startswith('+') else ''} {sql.lstrip().removeprefix('+')}"
        return f

    return put


_SIDES = "coalesce(sum(credit_paise), 0)::bigint as in_paise, coalesce(sum(debit_paise), 0)::bigint as out_paise"


@query(f"select date_trunc('month', txn_date)::date as period, {_SIDES}, sum(signed_paise)::bigint as net_paise, count(*) as n from txn group by 1")
def g2_monthly_summary(t, spark, sf_dir):
    return dashboards.by_period(t, "month")


@query(f"select txn_date as period, {_SIDES}, sum(signed_paise)::bigint as net_paise, count(*) as n from txn group by 1")
def g4_daily_cashflow(t, spark, sf_dir):
    return dashboards.by_period(t, "day")


@query(f"""+ l as (select account_id, balance_paise from (select *, row_number() over (partition by account_id order by txn_date desc, txn_id desc) r from txn) where r = 1)
select {_SIDES}, count(*) as n, count(distinct account_id) as accounts, max(txn_date) as last_date, min(txn_date) as first_date, (select sum(balance_paise)::bigint from l) as liquidity_paise from txn""")
def g1_summary(t, spark, sf_dir):
    return dashboards.summary(t)


@query("select account_id, balance_paise, txn_date from (select *, row_number() over (partition by account_id order by txn_date desc, txn_id desc) r from txn) where r = 1")
def p11_latest_balance(t, spark, sf_dir):
    return dashboards.latest_balance(t)


@query(f"""+ g as (select counterparty, {_SIDES}, count(*) as n from txn group by 1), a as (select sum(out_paise) as s from g)
select counterparty, in_paise, out_paise, n, case when s > 0 then floor(out_paise::double * 10000 / s::double)::bigint end as share_bp, case when out_paise >= in_paise then 'debit' else 'credit' end as side from g, a""")
def g3_breakdown(t, spark, sf_dir):
    return dashboards.breakdown(t, "counterparty")


@query("""+ g as (select counterparty, sum(debit_paise)::bigint as out_paise, count(*) as n from txn where debit_paise > 0 group by 1),
r as (select *, row_number() over (order by out_paise desc, counterparty) as k from g)
select counterparty, out_paise, n from r where k <= 8 union all select 'Other (' || count(*) || ')', sum(out_paise)::bigint, sum(n)::bigint from r where k > 8 having count(*) > 0""")
def g6_top_and_other(t, spark, sf_dir):
    return dashboards.top_and_other(t, "counterparty", 8)


@query("""+ g as (select counterparty, sum(debit_paise) as s from txn where debit_paise > 0 group by 1)
select count(*) as keys, sum(s)::bigint as all_paise, (select sum(s)::bigint from (select s from g order by s desc, counterparty limit 5)) as top_paise from g""")
def g7_concentration(t, spark, sf_dir):
    return dashboards.concentration(t, "counterparty", 5)


@query("""select entity_id, account_id, direction, coalesce(sum(debit_paise), 0)::bigint as out_paise, count(*) as n,
(3 - grouping(entity_id) - grouping(account_id) - grouping(direction))::int as depth from txn group by rollup (entity_id, account_id, direction)""")
def g9_rollup_tree(t, spark, sf_dir):
    return dashboards.rollup_tree(t, "entity_id", "account_id", "direction")


@query("""+ h as (select * from txn where narration ilike '%rent%') select txn_id, txn_date, amount_paise, narration, (select count(*) from h) as total from h order by txn_date desc, txn_id desc limit 25 offset 50""")
def p1_search_page(t, spark, sf_dir):
    return dashboards.page(t, "rent", 50, 25)


@query("select txn_id, txn_date, account_id, signed_paise from txn order by txn_date desc, txn_id desc limit 20")
def p14_recent(t, spark, sf_dir):
    return dashboards.recent(t, 20)


@query("select account_id, rank, txn_id, debit_paise from (select *, row_number() over (partition by account_id order by debit_paise desc, txn_id) as rank from txn where debit_paise > 0) where rank <= 5")
def p15_top_in_account(t, spark, sf_dir):
    return dashboards.ranked_in(t, "account_id", 5)


@query("select distinct counterparty, direction from txn")
def p10_labels(t, spark, sf_dir):
    return t.select("counterparty", "direction").distinct()


@query("""select txn_id, concat_ws(',', case when txn_date is null then 'date_missing' end, case when debit_paise is not null and credit_paise is not null then 'both_sides' end,
case when coalesce(debit_paise, credit_paise, 0) = 0 then 'no_amount' end, case when greatest(debit_paise, credit_paise) > 5000000000 then 'too_large' end, case when balance_paise < 0 then 'overdrawn' end) as errors from txn""")
def v2_row_rules(t, spark, sf_dir):
    return validation.row_rules(t)


@query(f"""+ {COPIES_SQL}, k as (select *, contains(upper(narration), 'UPI') as upi, lower(trim(regexp_replace(narration, '\\s+', ' ', 'g'))) as said from led where statement_id is not null)
select txn_id, first_id from (select txn_id, first(txn_id) over (partition by statement_id, txn_date, direction, amount_paise, coalesce(balance_paise, 0), upi,
  case when upi and coalesce(reference_no, '') <> '' then reference_no when upi then substr(said, 1, 60) else substr(said, 1, 80) end order by row_index, txn_id) as first_id from k) where txn_id <> first_id""")
def v5_duplicates_in_file(t, spark, sf_dir):
    return validation.duplicates_in_file(with_copies(t))


@query("""+ x as (select *, lag(balance_paise) over (partition by statement_id order by txn_date, row_index) as prev from txn)
select statement_id, count(*) as checked, sum((abs(balance_paise - prev - signed_paise) <= 100 or abs(balance_paise - prev + signed_paise) <= 100)::bigint)::bigint as ok from x where prev is not null group by 1""")
def v6_continuity(t, spark, sf_dir):
    return validation.continuity(t)


@query("""+ x as (select *, row_number() over (partition by statement_id order by txn_date, row_index) a, row_number() over (partition by statement_id order by txn_date desc, row_index desc) z from txn),
g as (select statement_id, max(case when a = 1 then balance_paise - signed_paise end) as opening, max(case when z = 1 then balance_paise end) as closing, sum(signed_paise)::bigint as net, count(*) as n from x group by 1)
select *, case when opening is null or closing is null then 'NOT_VERIFIABLE' when opening + net = closing then 'PASSED' else 'FAILED' end as verdict from g""")
def c4_statement_check(t, spark, sf_dir):
    return validation.statement_check(t)


_MORE = {"cash_withdrawal": " and debit_paise >= 20000000", "penal_charge": " and debit_paise > 0", "penal_interest": " and debit_paise > 0"}
_KW = " union all ".join(f"select '{k}' as kind, '{s}' as severity, account_id, txn_id, amount_paise from txn where regexp_matches(upper(narration), '{anomalies.pattern(p)}')" + _MORE.get(k, "") for k, (s, p) in anomalies.KEYWORDS.items())
FINDINGS_SQL = f"""+ d as (select * from txn where debit_paise > 0),
ast as (select account_id, avg(debit_paise) m, stddev_samp(debit_paise) s, count(*) c from d group by 1),
pst as (select counterparty, median(debit_paise) m, count(*) c from d group by 1),
w as (select *, lag(txn_date) over o as pd, lag(balance_paise) over o as pb, count(*) over (partition by account_id) as c,
  lead(debit_paise, 1) over o d1, lead(debit_paise, 2) over o d2, lead(debit_paise, 3) over o d3, lead(txn_date, 1) over o t1, lead(txn_date, 2) over o t2, lead(txn_date, 3) over o t3
  from txn window o as (partition by account_id order by txn_date, txn_id)),
days as (select account_id, txn_date, count(*) c, min(txn_id) txn_id, sum(amount_paise)::bigint amount_paise from txn group by 1, 2),
dst as (select account_id, avg(c) m, stddev_samp(c) s, count(*) k from days group by 1),
found as ({_KW}
union all select 'first_large_transfer', 'high', account_id, txn_id, amount_paise from (select *, row_number() over (partition by counterparty order by txn_date, txn_id) r from txn) where r = 1 and debit_paise >= 50000000
union all select 'amount_outlier', 'high', d.account_id, txn_id, amount_paise from d join ast using (account_id) where c >= 25 and debit_paise > m + 3.8 * s and debit_paise >= 50000000
union all select 'weekend_debit', 'low', account_id, txn_id, amount_paise from txn where isodow(txn_date) >= 6 and debit_paise >= 100000000
union all select 'activity_gap', 'medium', account_id, txn_id, amount_paise from w where c >= 15 and txn_date - pd > 60
union all select 'party_spike', 'medium', account_id, txn_id, amount_paise from d join pst using (counterparty) where c >= 5 and debit_paise > 2 * m and debit_paise - m >= 20000000
union all select 'balance_break', 'high', account_id, txn_id, amount_paise from w where pb is not null and abs(abs(balance_paise - pb) - amount_paise) > 100
union all select 'daily_surge', 'medium', days.account_id, txn_id, amount_paise from days join dst using (account_id) where k >= 20 and c > m + 3.8 * s and c >= 15
union all select 'pass_through', 'critical', account_id, txn_id, amount_paise from w where credit_paise >= 100000000 and ((d1 * 100 >= credit_paise * 95 and t1 - txn_date <= 1) or (d2 * 100 >= credit_paise * 95 and t2 - txn_date <= 1) or (d3 * 100 >= credit_paise * 95 and t3 - txn_date <= 1))
union all select 'future_date', 'medium', account_id, txn_id, amount_paise from txn where txn_date > date '{TODAY}' + 2)"""


@query(FINDINGS_SQL + " select * from found")
def a17_all_findings(t, spark, sf_dir):
    return anomalies.detect_all(t, TODAY)


@query(FINDINGS_SQL + " select kind, severity, count(*) as n, sum(amount_paise)::bigint as amount_paise from found group by 1, 2")
def a29_findings_overview(t, spark, sf_dir):
    return anomalies.findings_overview(anomalies.detect_all(t, TODAY))


@query("select account_id, txn_date, sum(amount_paise)::bigint as amount_paise, count(*) as n from txn where contains(upper(narration), 'CASH') group by 1, 2 having sum(amount_paise) >= 20000000")
def a19_daily_cash(t, spark, sf_dir):
    return anomalies.daily_cash(t, 2 * anomalies.LAKH)


@query("select account_id, txn_date, sum(debit_paise)::bigint as out_paise, count(*) as n from txn where debit_paise > 0 group by 1, 2 having sum(debit_paise) >= 50000000")
def a21_daily_outflow(t, spark, sf_dir):
    return anomalies.daily_outflow(t, 5 * anomalies.LAKH)


@query("select account_id, txn_date, count(*) as n from txn group by 1, 2 having count(*) > 2")
def a22_daily_count(t, spark, sf_dir):
    return anomalies.daily_count(t, 2)


@query("select account_id, txn_date, balance_paise as low_paise, txn_id from (select *, row_number() over (partition by account_id, txn_date order by balance_paise, txn_id) r from txn) where r = 1 and balance_paise < 0")
def a23_minimum_balance(t, spark, sf_dir):
    return anomalies.minimum_balance(t, 0)


@query("""+ d as (select account_id, txn_date, sum(debit_paise) o, count(*) n, min(balance_paise) b from txn group by 1, 2),
r as (select 'daily_outflow' as rule, count(o) as applicable, count(case when o >= 50000000 then 1 end) as violations from d
union all select 'daily_count', count(*), count(case when n > 2 then 1 end) from d union all select 'minimum_balance', count(b), count(case when b < 0 then 1 end) from d)
select *, case when applicable > 0 then floor((applicable - violations) * 10000.0 / applicable)::bigint end as pass_bp from r""")
def a26_compliance(t, spark, sf_dir):
    return anomalies.compliance(t, 5 * anomalies.LAKH, 2, 0)


_CLOSE = "c as (select account_id, txn_date, arg_max(balance_paise, txn_id) as close_paise from txn group by 1, 2), u as (select *, coalesce(lead(txn_date) over (partition by account_id order by txn_date) - 1, txn_date)::date as until from c)"


@query(f"+ {_CLOSE} select account_id, unnest(generate_series(txn_date, until, interval 1 day))::date as day, close_paise from u")
def t5_daily_balance(t, spark, sf_dir):
    return timeseries.daily_balance(t)


@query(f"""+ {_CLOSE}, k as (select txn_date, close_paise - coalesce(lag(close_paise) over (partition by account_id order by txn_date), 0) as ch from c)
select txn_date, (sum(sum(ch)) over (order by txn_date))::bigint as position_paise from k group by 1""")
def t4_cash_position(t, spark, sf_dir):
    return timeseries.cash_position(t)


@query(f"""+ {_CLOSE}, m as (select account_id, floor(sum(close_paise::double * ((until - txn_date) + 1)) / sum((until - txn_date) + 1))::bigint as mean_paise, sum((until - txn_date) + 1)::bigint as days from u group by 1),
e as (select account_id, arg_min(balance_paise - signed_paise, {{'d': txn_date, 't': txn_id}}) as opening, arg_max(balance_paise, {{'d': txn_date, 't': txn_id}}) as closing, min(balance_paise) as low, max(balance_paise) as high from txn group by 1)
select * from e join m using (account_id)""")
def t6_balances(t, spark, sf_dir):
    return timeseries.balances(t)


@query("""+ m as (select unnest(generate_series(date_trunc('month', min(txn_date)), date_trunc('month', max(txn_date)), interval 1 month))::date as month from txn), a as (select distinct account_id from txn),
g as (select account_id, date_trunc('month', txn_date)::date as month, sum(credit_paise) i, sum(debit_paise) o from txn group by 1, 2)
select a.account_id, m.month, coalesce(i, 0)::bigint as in_paise, coalesce(o, 0)::bigint as out_paise from a cross join m left join g using (account_id, month)""")
def t8_month_buckets(t, spark, sf_dir):
    return timeseries.month_buckets(t)


_CAD = " ".join(f"when gap between {lo} and {hi} then '{n}'" for n, _, lo, hi in timeseries.CADENCES)
_NOM = " ".join(f"when gap between {lo} and {hi} then {d}" for _, d, lo, hi in timeseries.CADENCES)
_SERIES = f"""x as (select *, txn_date - lag(txn_date) over (partition by account_id, direction, counterparty order by txn_date, txn_id) as g, row_number() over (partition by account_id, direction, counterparty order by txn_date desc, txn_id desc) as back from txn),
y as (select account_id, direction, counterparty, count(*) as n, median(g) as gap, median(case when back <= 10 then amount_paise end) as m, max(txn_date) as last_date from x group by 1, 2, 3 having count(*) >= 3),
series as (select account_id, direction, counterparty, n, (gap * 2)::bigint as gap_halves, floor(m)::bigint as amount_paise, last_date, case {_CAD} end as cadence, (case {_NOM} end)::int as nominal_days, case when n >= 6 then 'high' else 'medium' end as tier from y)"""


@query(f"+ {_SERIES} select * from series where cadence is not null")
def t1_recurring(t, spark, sf_dir):
    return timeseries.recurring(t)


@query(f"""+ {_SERIES}, v as (select h as horizon, tier, (h // nominal_days) * amount_paise * case when direction = 'credit' then 1 else -1 end as value from series, (values (30), (60), (90)) hs(h) where cadence is not null)
select horizon, sum(value)::bigint as expected_paise, coalesce(sum(case when tier = 'high' then value end), 0)::bigint as conservative_paise from v group by 1""")
def t2_forecast(t, spark, sf_dir):
    return timeseries.forecast(timeseries.recurring(t))


@query(f"""+ {RATES_SQL}, v as (select *, case when lag(as_of) over (order by as_of) is null then date '0001-01-01' else as_of end as f, coalesce(lead(as_of) over (order by as_of), date '9999-12-31') as e from rate)
select txn_id, inr_per_unit::double as inr_per_unit, ((amount_paise::hugeint * 20 + (inr_per_unit * 10)::bigint) // (2 * (inr_per_unit * 10)::bigint))::bigint as converted from txn join v on coalesce(txn_date, date '9999-12-30') >= f and coalesce(txn_date, date '9999-12-30') < e""")
def x3_convert(t, spark, sf_dir):
    return fx.convert(t, rates(spark), "USD")


_RANK = "case when source_type <> 'statement' then 1 else 0 end"
TIER1_SQL = f"""+ {COPIES_SQL}, p as (select a.txn_id ai, b.txn_id bi, {_RANK.replace('source_type', 'a.source_type')} ra, {_RANK.replace('source_type', 'b.source_type')} rb, a.row_index ia, b.row_index ib
from led a join led b on a.account_id = b.account_id and a.reference_no = b.reference_no and a.direction = b.direction and a.amount_paise = b.amount_paise and a.txn_id < b.txn_id
where abs(a.txn_date - b.txn_date) <= 3 and (a.balance_paise is null or b.balance_paise is null or a.balance_paise = b.balance_paise)),
pairs as (select case when (ra, ia, ai) <= (rb, ib, bi) then ai else bi end as kept_id, case when (ra, ia, ai) <= (rb, ib, bi) then bi else ai end as duplicate_id from p)"""


@query(TIER1_SQL + " select * from pairs")
def d2_tier_one(t, spark, sf_dir):
    return matching.tier_one(with_copies(t))


@query(f"""+ {COPIES_SQL}, k as (select *, list_distinct(list_filter(string_split(regexp_replace(upper(narration), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda s: s <> '')) as tok from led)
select a.txn_id as a_id, b.txn_id as b_id, (case when a.reference_no is not null and b.reference_no is not null then 6000 when a.txn_date = b.txn_date then 8500
else 7000 + floor(len(list_intersect(a.tok, b.tok)) * 1000 / greatest(len(list_distinct(list_concat(a.tok, b.tok))), 1)) end)::bigint as score
from k a join k b on a.account_id = b.account_id and a.direction = b.direction and a.amount_paise = b.amount_paise and a.txn_id < b.txn_id
where abs(a.txn_date - b.txn_date) <= 3 and not coalesce(a.statement_id = b.statement_id, false) and not coalesce(a.balance_paise <> b.balance_paise, false) and not coalesce(a.reference_no = b.reference_no, false)""")
def d3_tier_two(t, spark, sf_dir):
    return matching.tier_two(with_copies(t))


@query(TIER1_SQL + " select account_id, count(*) as n, sum(amount_paise)::bigint as amount_paise from led where txn_id not in (select duplicate_id from pairs) group by 1")
def d5_survivors(t, spark, sf_dir):
    led = with_copies(t)
    return matching.survivors(led, matching.tier_one(led)).groupBy("account_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount_paise").cast("long").alias("amount_paise"))


_PASS_B = f"""{BOOKS_SQL}, bk as (select *, row_number() over (partition by account_id, direction, amount_paise, entry_date order by book_id) k from book),
tk as (select *, row_number() over (partition by account_id, direction, amount_paise, txn_date order by txn_id) k from txn),
m as (select book_id, txn_id from bk join tk on bk.account_id = tk.account_id and bk.direction = tk.direction and bk.amount_paise = tk.amount_paise and bk.entry_date = tk.txn_date and bk.k = tk.k)"""


@query(f"+ {_PASS_B} select * from m")
def j9_same_day(t, spark, sf_dir):
    return matching.same_day(books(t), t)


@query(f"""+ {_PASS_B}, c as (select book_id, txn_id from book b join txn t using (account_id, direction, amount_paise) where abs(b.entry_date - t.txn_date) <= 7)
select book_id, txn_id from (select *, count(*) over (partition by book_id) x, count(*) over (partition by txn_id) y from c) where x = 1 and y = 1""")
def j10_only_candidates(t, spark, sf_dir):
    return matching.only_candidates(books(t), t)


@query()
def j7_reconcile(t, spark, sf_dir):
    return matching.reconcile(books(t), t)


@query(f"""+ {_PASS_B} select account_id, count(*) as n, sum(amount_paise)::bigint as amount_paise, 'book' as side from book where book_id not in (select book_id from m) group by 1
union all select account_id, count(*), sum(amount_paise)::bigint, 'bank' from txn where txn_id not in (select txn_id from m) group by 1""")
def j15_bridge(t, spark, sf_dir):
    b = books(t)
    return matching.bridge(b, t, matching.same_day(b, t))


@query(f"""+ {_PASS_B}, i as (select 'book' as side, entry_date as d, amount_paise from book where book_id not in (select book_id from m) union all select 'bank', txn_date, amount_paise from txn where txn_id not in (select txn_id from m)),
a as (select *, date '{TODAY}' - d as age from i), b as (select * from (values (1, '0-30'), (2, '31-60'), (3, '61-90'), (4, '90+')) v(pos, band)),
g as (select case when age <= 30 then 1 when age <= 60 then 2 when age <= 90 then 3 else 4 end as pos, sum(case when side = 'bank' then amount_paise end) x, sum(case when side = 'book' then amount_paise end) y, count(*) n from a group by 1)
select b.pos, band, coalesce(x, 0)::bigint as bank_paise, coalesce(y, 0)::bigint as book_paise, coalesce(n, 0)::bigint as n from b left join g using (pos)""")
def g5_ageing(t, spark, sf_dir):
    b = books(t)
    m = matching.same_day(b, t)
    open_ = b.join(m, "book_id", "left_anti").select(F.lit("book").alias("side"), F.col("entry_date").alias("item_date"), "amount_paise").unionByName(t.join(m, "txn_id", "left_anti").select(F.lit("bank").alias("side"), F.col("txn_date").alias("item_date"), "amount_paise"))
    return dashboards.ageing(open_, TODAY)


@query(f"""+ {TRANSFERS_SQL}, x as (select d.txn_id as debit_id, c.txn_id as credit_id, case when regexp_extract(d.narration, '[0-9]{{9,}}') <> '' and regexp_extract(d.narration, '[0-9]{{9,}}') = regexp_extract(c.narration, '[0-9]{{9,}}') then 'shared reference'
when regexp_matches(d.narration, 'X{{2,}}' || right('9000' || lpad(c.account_id::varchar, 6, '0'), 4)) then 'account number' end as evidence
from tled d join tled c on d.direction = 'debit' and c.direction = 'credit' and d.amount_paise = c.amount_paise and d.account_id <> c.account_id and c.txn_date - d.txn_date between 0 and 3) select * from x where evidence is not null""")
def c6_transfers(t, spark, sf_dir):
    return matching.transfers(*with_transfers(t))


def _cases(patterns, default="null"):
    return "case " + " ".join(f"when regexp_matches(upper(narration), '{p}') then '{n}'" for n, p in patterns) + f" else {default} end"


@query(f"""select txn_id, {_cases(classify.RAILS)} as rail, {_cases(classify.CASH)} as cash, {_cases(classify.FLOWS, "case when direction = 'credit' then 'INCOME' else 'EXPENSE' end")} as flow from txn""")
def r29_describe(t, spark, sf_dir):
    return classify.describe(t)


_RULE_SQL = """+ h as (select txn_id, unnest([case when contains(upper(narration), 'SALARY') and direction = 'credit' then {'p': 50, 'i': 0, 'id': 'r-salary', 'c': 'Income'} end,
case when (contains(upper(narration), 'RENT') or contains(upper(narration), 'HOME LOAN')) and not contains(upper(narration), 'REVERSAL') then {'p': 40, 'i': -1, 'id': 'r-home', 'c': 'Housing'} end,
case when regexp_matches(upper(narration), 'CHARGES|PENAL') then {'p': 30, 'i': -2, 'id': 'r-bank', 'c': 'Charges'} end,
case when amount_paise >= 40000000 then {'p': 45, 'i': -3, 'id': 'r-large', 'c': 'Large'} end,
case when contains(upper(narration), 'UPI') and contains(upper(narration), 'ATM') then {'p': 99, 'i': -4, 'id': 'r-never', 'c': 'Never'} end]) as x from txn),
b as (select txn_id, max(x) as x from h where x is not null group by 1), w as (select t.txn_id, b.x.id as rule_id, coalesce(b.x.c, 'Other') as category from txn t left join b using (txn_id))"""


@query(_RULE_SQL + " select * from w")
def k14_caller_rules(t, spark, sf_dir):
    return classify.Ruleset(RULES).evaluate(t)


@query(_RULE_SQL + " select rule_id, count(w.txn_id) as hits from (values ('r-salary'), ('r-home'), ('r-bank'), ('r-large'), ('r-never')) r(rule_id) left join w using (rule_id) group by 1")
def k17_rule_usage(t, spark, sf_dir):
    return classify.Ruleset(RULES).usage(t)


_WORDS_SQL = ", ".join(f"('{w}', '{c}', {s})" for w, c, s in WORDS)


@query(f"""+ r as (select * from (values {_WORDS_SQL}) v(word, category, score)), k as (select txn_id, unnest(list_distinct(string_split(regexp_replace(upper(narration), '[^A-Z]+', ' ', 'g'), ' '))) as word from txn),
p as (select txn_id, category, max(score) as score from k join r using (word) group by 1, 2), m as (select txn_id, max(score) as score from p group by 1)
select txn_id, score::int as score, max(category) as category, count(*) > 1 as ambiguous from p join m using (txn_id, score) group by 1, 2""")
def k2_keyword_scores(t, spark, sf_dir):
    return classify.keyword_scores(t, F.broadcast(spark.createDataFrame(WORDS, "word string, category string, score int")))


@query("""select txn_id, sha256(concat_ws('|', account_id::varchar, strftime(txn_date, '%Y-%m-%d'), direction, amount_paise::varchar, coalesce(reference_no, ''))) as hash,
repeat('*', length(reference_no) - 4) || right(reference_no, 4) as masked from txn""")
def r46_hash_and_mask(t, spark, sf_dir):
    return t.select("txn_id", text.row_hash(*map(F.col, ("account_id", "txn_date", "direction", "amount_paise", "reference_no"))).alias("hash"), text.mask(F.col("reference_no")).alias("masked"))


@query("""select txn_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(upper(narration), '[0-9]{6,}', ' ', 'g'), '[^A-Z0-9]+', ' ', 'g'), ' '), lambda w: length(w) > 1 and not regexp_full_match(w, '[0-9]+'))[1:4], ' ') as key from txn""")
def r28_series_key(t, spark, sf_dir):
    return t.select("txn_id", text.series_key(F.col("narration")).alias("key"))


@query("""+ e as (select date_trunc('hour', ts) as start, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as value_cents from events group by 1, 2) select * from e""")
def s1_tumbling_usage(t, spark, sf_dir):
    return metering.tumbling_usage(read(spark, sf_dir, "events"))


@query("""+ p as (select page_id, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') as s from pages)
select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&amp;', '&'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) as text_md5 from p""")
def sc37_html_text(t, spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("""+ n as (select p_partkey as id, p_name || ' ' || p_type as name from part), k as (select id, name, replace(upper(name), ' ', '') as x from n), d as (select distinct x from k)
select a.x as a_name, b.x as b_name, floor((greatest(length(a.x), length(b.x)) - levenshtein(a.x, b.x)) * 1000 / greatest(length(a.x), length(b.x)))::bigint as ratio
from d a join d b on a.x < b.x and substr(a.x, 1, 5) = substr(b.x, 1, 5)""")
def e4_name_pairs(t, spark, sf_dir):
    n = read(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return similarity.edit_ratios(n, "name", prefix=5)


@query()
def e10_name_clusters(t, spark, sf_dir):
    n = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Party "), F.regexp_replace("c_name", "0+", " ")).alias("name"))
    return entities.clusters_of_names(n, least=860)


_EVIDENCE = f"""e as (select account_id, direction, counterparty, count(*)::bigint as k, sum(amount_paise)::hugeint as total, count(distinct date_trunc('month', txn_date))::bigint as months,
  bool_or(regexp_matches(upper(narration), 'SALARY')) as salary, bool_or(regexp_matches(upper(narration), '{credit.DEBT}')) as debt,
  count(*) * sum(day(txn_date) * day(txn_date))::hugeint - sum(day(txn_date))::hugeint * sum(day(txn_date))::hugeint as ds, count(*) * sum(amount_paise::hugeint * amount_paise)::hugeint - sum(amount_paise)::hugeint * sum(amount_paise)::hugeint as am from txn group by 1, 2, 3),
es as (select * from series join e using (account_id, direction, counterparty) where cadence is not null)"""


@query(f"""+ {_SERIES}, {_EVIDENCE}, c as (select *, least(97, 50 + case when salary then 20 else 0 end + case when n >= 6 then 10 else 0 end + case when am * 400 <= total * total then 7 else 0 end + case when ds <= 9 * k * k then 5 else 0 end)::int as confidence from es where direction = 'credit')
select account_id, confidence, amount_paise, counterparty from (select *, row_number() over (partition by account_id order by confidence desc, amount_paise desc, counterparty desc) r from c where confidence >= 70) where r = 1""")
def t13_salary(t, spark, sf_dir):
    return credit.salary(t)


@query(f"""+ {_SERIES} select account_id, direction, sum(amount_paise * 30 // nominal_days)::bigint as monthly_paise, count(*) as series, count(case when tier = 'high' then 1 end) * 10000 // count(*) as high_bp from series where cadence is not null group by 1, 2""")
def t14_monthly_equivalent(t, spark, sf_dir):
    return credit.monthly_equivalent(timeseries.recurring(t).where("cadence is not null"))


_INCOME = """p as (select account_id, counterparty, sum(credit_paise)::hugeint as s from txn where credit_paise > 0 group by 1, 2), pm as (select account_id, arg_max(counterparty, {'s': s, 'c': counterparty}) as largest, max(s) as ms, count(*) as sources from p group by 1),
inc as (select account_id, sum(credit_paise)::bigint as total_paise, count(*) as n, sources, count(distinct date_trunc('month', txn_date)) as months, largest, (ms * 10000 // sum(credit_paise)::hugeint)::bigint as largest_bp from txn join pm using (account_id) where credit_paise > 0 group by account_id, sources, largest, ms)"""


@query(f"+ {_INCOME} select * from inc")
def t12_income(t, spark, sf_dir):
    return credit.income(t)


def _part(p):
    return f"coalesce(sum(case when part = '{p}' then debit_paise end), 0)::bigint as {p}_paise"


_EXPENSES = f"""ex as (select account_id, sum(debit_paise)::bigint as total_paise, {", ".join(_part(p) for p in [*dict(credit.SPENDING), "unattributed"])}, count(distinct date_trunc('month', txn_date)) as months
from (select *, {_cases(credit.SPENDING, "'unattributed'")} as part from txn where debit_paise > 0) group by 1)"""


@query(f"+ {_EXPENSES} select * from ex")
def t15_expenses(t, spark, sf_dir):
    return credit.expenses(t)


_OBLIGATIONS = f"""{_SERIES}, {_EVIDENCE}, ob as (select account_id, counterparty, amount_paise, ((2 * total + months) // (2 * months))::bigint as monthly_paise, (case when debt and shape then 90 when debt then 80 when shape then 55 end)::int as confidence
from (select *, am * 2500 <= total * total and ds <= 9 * k * k as shape from es where direction = 'debit' and cadence = 'monthly') where debt or shape)"""


@query(f"+ {_OBLIGATIONS} select * from ob")
def t16_obligations(t, spark, sf_dir):
    return credit.obligations(t)


@query(f"""+ {_OBLIGATIONS}, {_INCOME}, {_EXPENSES}, dt as (select account_id, sum(monthly_paise)::bigint as d from ob group by 1),
af as (select account_id, coalesce(inc.total_paise // inc.months, 0)::bigint as income_paise, coalesce(d, 0)::bigint as debt_paise, coalesce(essential_paise // ex.months, 0)::bigint as essential_paise
  from (select distinct account_id from txn) left join inc using (account_id) left join dt using (account_id) left join ex using (account_id)),
av as (select *, case when income_paise > 0 then debt_paise * 10000 // income_paise end as ratio_bp, income_paise - greatest(debt_paise, essential_paise) as left_paise from af)
select *, case when ratio_bp is null then 'insufficient_data' when left_paise < {credit.LEAST_DISPOSABLE} then 'not_affordable' when ratio_bp < {credit.COMFORTABLE_BP} then 'affordable' when ratio_bp < {credit.STRETCHED_BP} then 'marginal' else 'not_affordable' end as verdict from av""")
def t17_affordability(t, spark, sf_dir):
    return credit.affordability(t)


@query(f"""{FINDINGS_SQL}, {_CLOSE}, dd as (select account_id, sum(until - txn_date + 1)::bigint as days, coalesce(sum(case when close_paise < 0 then until - txn_date + 1 end), 0)::bigint as negative_days, coalesce(sum(case when close_paise < 100000000 then until - txn_date + 1 end), 0)::bigint as breach_days from u group by 1),
fe as (select account_id, count(*) as c, sum(debit_paise)::bigint as p from txn where debit_paise > 0 and regexp_matches(upper(narration), '{credit.PENAL}') group by 1),
fo as (select account_id, sum(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end)::bigint as w from found group by 1),
x as (select account_id, days, negative_days, breach_days, coalesce(c, 0)::bigint as charges, coalesce(p, 0)::bigint as charges_paise, coalesce(w, 0)::bigint as weighted from dd left join fe using (account_id) left join fo using (account_id))
select *, 3500 * least(charges, 6) // 6 + 2500 * negative_days // days + 2000 * breach_days // days + 2000 * least(weighted, 8) // 8 as stress_bp from x""")
def t18_risk(t, spark, sf_dir):
    return credit.risk(t, TODAY, 100000000)


@query("""+ g as (select account_id, (max(txn_date) - min(txn_date) + 1)::bigint as days, count(distinct date_trunc('month', txn_date)) as months, count(*) as n from txn group by 1)
select *, concat_ws(',', case when days < 90 then 'short_history' end, case when n < 5 * months then 'sparse_history' end) as warnings from g""")
def t20_history_warnings(t, spark, sf_dir):
    return credit.history_warnings(t)


@query(f"""+ {BOOKS_SQL}, c as (select book_id, txn_id, abs(entry_date - txn_date) as gap, abs(b.amount_paise - t.amount_paise) as off from book b join txn t on b.account_id = t.account_id and b.direction = t.direction and b.instrument_no = t.reference_no
where abs(entry_date - txn_date) <= 7 and b.amount_paise <> t.amount_paise) select book_id, txn_id, off::bigint as off_paise from (select *, row_number() over (partition by book_id order by gap, off, txn_id) r from c) where r = 1""")
def j11_other_amounts(t, spark, sf_dir):
    return matching.other_amounts(books(t), t)


def _report_sql(amount, since, until, rows="true"):
    return f"+ x as (select * from txn where txn_date >= date '{since}' and txn_date < date '{until}' and {rows}) select txn_id, txn_date, account_id, narration, {amount} as value_paise, (select sum({amount}) from x)::bigint as total_paise from x"


@query(_report_sql("signed_paise", "1997-03-01", "1997-04-01"))
def g13_monthly_report(t, spark, sf_dir):
    return reports.period_report(t, "1997-03-01", "1997-04-01")


@query(_report_sql("signed_paise", "1997-01-01", "1998-01-01"))
def g14_yearly_report(t, spark, sf_dir):
    return reports.period_report(t, "1997-01-01", "1998-01-01")


@query(_report_sql("debit_paise", "1996-04-01", "1997-04-01", "debit_paise > 0"))
def g15_expense_report(t, spark, sf_dir):
    return reports.period_report(t, "1996-04-01", "1997-04-01", "debit")


@query(_report_sql("credit_paise", "1996-04-01", "1997-04-01", "credit_paise > 0"))
def g16_income_report(t, spark, sf_dir):
    return reports.period_report(t, "1996-04-01", "1997-04-01", "credit")


@query("""+ l as (select account_id, balance_paise from (select *, row_number() over (partition by account_id order by txn_date desc, txn_id desc) r from txn) where r = 1)
select account_id, balance_paise, (500000000 - balance_paise)::bigint as short_paise from l where balance_paise < 500000000""")
def g18_breaches(t, spark, sf_dir):
    return reports.breaches(t, 500000000)


@query("""+ s as (select counterparty, narration, count(*) k, sum(amount_paise) a, min(txn_date) f, max(txn_date) l, row_number() over (partition by counterparty order by narration) r from txn group by 1, 2)
select counterparty, sum(k)::bigint as n, sum(a)::bigint as amount_paise, count(*) as spellings, min(f) as first_date, max(l) as last_date, arg_max(narration, {'k': k, 's': narration}) as spelling, string_agg(case when r <= 3 then narration end, ' | ' order by narration) as samples from s group by 1""")
def g19_party_groups(t, spark, sf_dir):
    return reports.party_groups(t)


@query("""+ c as (select event_type, round(value * 100)::bigint as c, row_number() over (partition by event_type order by value) as r, count(*) over (partition by event_type) as n from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-20')
select event_type, n, sum(c)::bigint as value_cents, max(case when r = ((95 * n + 99) // 100) then c end) as p95_cents from c group by 1, 2""")
def g20_usage_summary(t, spark, sf_dir):
    return reports.usage_summary(read(spark, sf_dir, "events"), "2024-01-05", "2024-01-20")


_PLACED = f"pl as (select *, {_cases(tree.PLACES, chr(39) + 'Other>' + chr(39) + ' || case when direction = ' + chr(39) + 'credit' + chr(39) + ' then ' + chr(39) + 'Income' + chr(39) + ' else ' + chr(39) + 'Expense' + chr(39) + ' end')} as path from txn)"


@query(f"+ {_PLACED} select txn_id, path from pl")
def k9_place(t, spark, sf_dir):
    return tree.place(t).select("txn_id", "path")


@query(f"""+ {_PLACED} select string_split(path, '>')[1] as family, count(*) as n, floor(sum(amount_paise) / count(*))::bigint as mean_score from pl group by 1""")
def g8_health(t, spark, sf_dir):
    return reports.health(tree.place(t).withColumn("root", F.split("path", ">")[0]), "root", "amount_paise")


@query(f"""+ {_PLACED} select string_split(path, '>')[2] as child, count(*) as n, coalesce(sum(credit_paise), 0)::bigint as in_paise, coalesce(sum(debit_paise), 0)::bigint as out_paise, bool_or(len(string_split(path, '>')) > 2) as has_children from pl where path = 'Housing' or starts_with(path, 'Housing>') group by 1""")
def g9_drilldown(t, spark, sf_dir):
    return tree.drilldown(tree.place(t), "Housing")


@query(f"+ {_PLACED} select txn_id, txn_date, path, amount_paise from pl where path = 'Charges' or starts_with(path, 'Charges>') order by txn_date desc, txn_id desc limit 30 offset 10")
def g10_rows_at(t, spark, sf_dir):
    return tree.rows_at(tree.place(t), "Charges", 10, 30)


@query(f"+ {_PLACED} select len(string_split(path, '>'))::int as depth, not starts_with(path, 'Other>') as known, count(*) as n, sum(amount_paise)::bigint as amount_paise from pl group by 1, 2")
def g11_coverage(t, spark, sf_dir):
    return tree.coverage(tree.place(t))


_NEIGHBOURS = "c as (select c_custkey as id, c_name || ' ' || c_mktsegment as name from customer), nb as (select a.id, a.name as x, b.name as y from c a join c b on b.id = a.id + 1)"


def _neighbours(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("name"))
    return c.withColumnRenamed("name", "x").join(c.select((F.col("id") - 1).alias("id"), F.col("name").alias("y")), "id")


@query(f"+ {_NEIGHBOURS} select id::bigint as id, round(jaro_winkler_similarity(x, y) * 10000)::bigint as score_bp from nb")
def e5_jaro_winkler(t, spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", F.round(similarity.jaro_winkler("x", "y") * 10000).cast("long").alias("score_bp"))


_GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3)))"


@query(f"""+ {_NEIGHBOURS}, u as (select id, regexp_replace(upper(x), '[^A-Z0-9]', '', 'g') as x, regexp_replace(upper(y), '[^A-Z0-9]', '', 'g') as y from nb), g as (select id, {_GRAMS.format('x')} as a, {_GRAMS.format('y')} as b from u)
select id::bigint as id, (len(list_intersect(a, b)) * 20000 // (len(a) + len(b)))::bigint as dice_bp from g""")
def e6_trigram_dice(t, spark, sf_dir):
    return _neighbours(spark, sf_dir).select("id", similarity.dice(similarity.trigrams(F.col("x")), similarity.trigrams(F.col("y"))).alias("dice_bp"))


@query("""+ c as (select c_nationkey as k, c_mktsegment as s, count(*) as n from customer group by 1, 2), v as (select (select sum(n * (n - 1) // 2) from c)::bigint as together,
(select sum(n * (n - 1) // 2) from (select sum(n) as n from c group by k))::bigint as predicted, (select sum(n * (n - 1) // 2) from (select sum(n) as n from c group by s))::bigint as actual)
select *, together * 10000 // predicted as precision_bp, together * 10000 // actual as recall_bp from v""")
def e13_against_truth(t, spark, sf_dir):
    return similarity.against_truth(read(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment")


_SKELETON = "substr(list_reduce(string_split(regexp_replace(regexp_replace(upper({0}), '[^A-Z]|[AEIOU]', '', 'g'), '(.)H+', '\\1', 'g'), ''), lambda a, b: case when right(a, 1) = b then a else a || b end), 1, 12)"


@query(f"""+ n as (select distinct p_name as name from part where p_name is not null), x as (select 'prefix' as kind, name, substr(regexp_replace(upper(name), '[^A-Z0-9]', '', 'g'), 1, 4) as key from n
  union all select 'skeleton', name, {_SKELETON.format("name")} from n)
select kind, key, count(*) as names, min(name) as keep from x where length(key) >= case kind when 'prefix' then 4 else 3 end group by 1, 2 having count(*) > 1""")
def k20_merge_suggestions(t, spark, sf_dir):
    return similarity.merge_suggestions(read(spark, sf_dir, "part"), "p_name", 4)


from . import catalog_books, catalog_more, catalog_names, catalog_text  # noqa: E402, F401  register their queries


def entry(spark: SparkSession) -> DataFrame:
    return g2_monthly_summary(ledger(spark, "/root/testdata/sf0.001"), spark, "/root/testdata/sf0.001")


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
