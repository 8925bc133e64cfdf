"""Queries over books files and over decisions about parties, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog import _SKELETON, query
from .functions import text
from .operators import consolidation, memory
from .plans.ledger import read
from .plans.scratch import stored
from .sources import books

#: Layouts of books by account modulo 4: columns and separator.
_LAYOUTS = [
    (("Date", "Particulars", "Vch Type", "Vch No.", "Cheque/Ref No.", "Debit", "Credit"), ","),
    (("date", "description", "debit", "credit"), ","),
    (("Voucher Date", "Narration", "Receipts", "Payments"), ";"),
    (("Entry Date", "Remarks", "Deposit"), ","),
]


def _books_files(t):
    """The ledger as one books file an account, in four layouts whose sides differ: an opening and a closing row, one entry in 17 without a day. Returns file and content, stored."""
    receipt = F.col("direction") == "credit"
    said = F.concat(F.when(receipt, "Receipt T").otherwise("Payment T"), "txn_id", F.lit(" "), "narration")
    entry = t.select("account_id", F.col("txn_id").alias("k"), F.when(F.col("txn_id") % 17 != 3, F.col("txn_date")).alias("day"), said.alias("said"), F.when(receipt, "Receipt").otherwise("Payment").alias("kind"),
                     F.concat(F.lit("V"), "txn_id").alias("voucher"), F.concat(F.lit("I"), "txn_id").alias("instrument"), F.col("credit_paise").alias("i"), F.col("debit_paise").alias("o"))
    label = lambda place, what, paise: F.struct(F.lit(place).cast("long").alias("k"), F.lit(what).alias("said"), paise.cast("long").alias("i"))
    labels = F.array(label(-2, "Header", F.lit(None)), label(-1, "Opening Balance", F.col("account_id") * 100 + 7), label(2**62, "Closing  Balance", F.col("account_id") * 1000 + 3))
    rows = entry.unionByName(t.select("account_id").distinct().select("account_id", F.inline(labels)), allowMissingColumns=True)
    units = lambda c: (F.col(c) / 100).cast("decimal(20,2)")
    plain, grouped = lambda c: units(c).cast("string"), lambda c: F.format_number(units(c), 2)
    signed = F.when(F.col("o").isNotNull(), F.concat(F.lit("("), plain("o"), F.lit(")"))).otherwise(plain("i"))
    values = [
        (F.date_format("day", "dd-MM-yyyy"), F.col("said"), F.col("kind"), F.col("voucher"), F.col("instrument"), grouped("i"), grouped("o")),
        (F.date_format("day", "yyyy-MM-dd"), F.col("said"), plain("o"), plain("i")),
        (F.date_format("day", "dd/MM/yyyy"), F.col("said"), plain("i"), plain("o")),
        (F.date_format("day", "dd-MMM-yyyy"), F.col("said"), signed),
    ]
    line = F.lit(None).cast("string")
    for k, ((names, sep), cols) in enumerate(zip(_LAYOUTS, values, strict=True)):
        told = F.to_csv(F.struct(*[c.alias(n) for n, c in zip(names, cols, strict=True)]), {"sep": sep})
        line = F.when(F.col("account_id") % 4 == k, F.when(F.col("k") == -2, sep.join(names)).otherwise(told)).otherwise(line)
    # rows of a table, as a file on a file system for each account takes most of the time
    content = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n"), F.lit("\n"))
    files = rows.select("account_id", "k", line.alias("line")).groupBy("account_id").agg(content.alias("content"))
    return stored(files.select(F.concat(F.lit("account_id="), "account_id", F.lit(".csv")).alias("file"), F.encode("content", "UTF-8").alias("content")), "books-files")


_DATED = "txn_id % 17 <> 3"


def _account():
    return F.regexp_extract("file", r"account_id=(\d+)", 1).cast("long").alias("account_id")


@query(f"""select account_id, (case direction when 'credit' then 'Receipt T' else 'Payment T' end) || txn_id || ' ' || narration as narration, txn_date as entry_date,
case when account_id % 4 = 0 then 'V' || txn_id end as voucher_no, case when account_id % 4 = 0 then 'I' || txn_id end as instrument_no,
coalesce(credit_paise, 0) as money_in_paise, coalesce(debit_paise, 0) as money_out_paise from txn where {_DATED}""")
def sc29_books_entries(t, spark, sf_dir):
    rows = books.entries(books.read_books(spark, _books_files(t)))
    return rows.select(_account(), "narration", "entry_date", "voucher_no", "instrument_no", "money_in_paise", "money_out_paise")


@query(f"""+ x as (select account_id, count(*) filter ({_DATED}) as row_count, count(*) filter (not {_DATED}) as skipped, count(*) filter ({_DATED} and direction = 'debit' and account_id % 4 = 3) as negative,
min(txn_date) filter ({_DATED}) as period_from, max(txn_date) filter ({_DATED}) as period_to from txn group by 1)
select *, false as refused, account_id * 100 + 7 as opening_paise, 'ledger_file' as opening_source,
account_id * 1000 + 3 as closing_paise from x""")
def sc29_books_batches(t, spark, sf_dir):
    rows = books.batches(books.read_books(spark, _books_files(t)))
    return rows.select(_account(), "row_count", "skipped", "negative", "period_from", "period_to", "refused", "opening_paise", "opening_source", "closing_paise")


@query("""+ n as (select account_id, max((direction = 'credit')::int) as i, max((direction = 'debit')::int) as o from txn group by 1)
select account_id, false as is_statement, 1::bigint as header_at, 0 as entry_date, 1 as narration, case account_id % 4 when 0 then 5 when 1 then 3 else 2 end as money_in,
case when o = 1 then case account_id % 4 when 0 then 6 when 1 then 2 when 2 then 3 end end as money_out, account_id % 4 = 1 as debit_out from n""")
def sc28_books_roles(t, spark, sf_dir):
    """Roles of the columns and the side of the debit column; columns here are named by what they mean: layout 1 has receipts in its credit column."""
    rows = books.lines(spark, _books_files(t))
    by = books.roles(rows)
    by = by.join(books.sides(books.typed_lines(rows, by)), "file")
    swapped = F.col("debit_out")
    return by.select(_account(), "is_statement", "header_at", "entry_date", "narration", F.when(swapped, F.col("money_out")).otherwise(F.col("money_in")).alias("money_in"),
                     F.when(swapped, F.col("money_in")).otherwise(F.col("money_out")).alias("money_out"), "debit_out")


@query("""select txn_id, case when txn_id % 10 = 0 or count(*) over (partition by account_id) > 1 then direction end as direction, txn_id % 10 <> 0 and count(*) over (partition by account_id) > 1 as by_place from txn""")
def r17_sides_by_place(t, spark, sf_dir):
    """An account's rows as one printed statement whose amounts stand in two unnamed columns, debits on the left of even accounts and on the right of odd ones; one row in ten tells its side."""
    left = (F.col("direction") == "debit") == (F.col("account_id") % 2 == 0)
    n = F.row_number().over(Window.partitionBy("account_id").orderBy("txn_date", "txn_id"))
    rows = t.select("txn_id", F.col("account_id").alias("file"), n.alias("n"), (F.when(left, 400).otherwise(470) + F.col("txn_id") % 7 / 2).alias("at"), "amount_paise", "balance_paise", F.when(F.col("txn_id") % 10 == 0, F.col("direction")).alias("direction"))
    return consolidation.sides_by_place(rows).select("txn_id", "direction", "by_place")


# ---- decisions about parties


@query("""select txn_id, regexp_matches(narration, '(^|[^A-Z0-9])(LOAN|SALARY|BILL)([^A-Z0-9]|$)') as said from txn""")
def r20_damaged_words(t, spark, sf_dir):
    """Words found in narrations whose letters are damaged; the SQL looks for them in the sound ones."""
    return t.select("txn_id", text.says(F.translate("narration", "OISBL", "01581"), "loan", "salary", "bill").alias("said"))


_L, _D = "length(regexp_replace(w, '[^A-Z]', '', 'g'))", "length(regexp_replace(w, '[^0-9]', '', 'g'))"
_REPAIRED = "array_to_string(list_transform(string_split({0}, ' '), lambda w: case when " + f"{_L} >= 2 and {_D} > 0 and {_D} * 2 <= {_L}" + " then translate(w, '0158', 'OISB') else w end), ' ')"
_SPELT = "case {0} % 4 when 1 then translate(name, 'OS', '05') when 2 then replace(name, 'A', 'AE') else name end"


def _spelt(k):
    name = F.col("name")
    return F.when(k % 4 == 1, F.translate(name, "OS", "05")).when(k % 4 == 2, F.replace(name, F.lit("A"), F.lit("AE"))).otherwise(name)


@query(f"""+ p as (select p_partkey as id, p_partkey // 40 as owner, upper(p_name || ' ' || p_type) as name, p_size from part),
e as (select owner, {_SPELT.format("id")} as key, 'C' || p_size % 3 as category, id from p where id % 3 = 0),
ch as (select *, (lag(category) over w is distinct from category)::int as c from e window w as (partition by owner, key order by id)),
ru as (select *, sum(c) over (partition by owner, key order by id rows unbounded preceding) as run from ch),
g as (select owner, key, run, any_value(category) as category, count(*) as confirmed from ru group by 1, 2, 3),
m as (select owner, key, arg_max(category, run) as category, arg_max(confirmed, run) as confirmed from g group by 1, 2),
s0 as (select *, {_SKELETON.format("key")} as lookup from m),
s1 as (select *, min(category) over w as a, max(category) over w as z, row_number() over (partition by owner, lookup order by confirmed desc, key) as r from s0 where length(lookup) >= 6 window w as (partition by owner, lookup)),
i0 as (select owner, key as lookup, 0 as rank, 'exact' as "by", key, category, confirmed from m union all select owner, {_REPAIRED.format("key")}, 1, 'repaired', key, category, confirmed from m
  union all select owner, lookup, 2, 'skeleton', key, category, confirmed from s1 where a = z and r = 1),
i as (select * from (select *, row_number() over (partition by owner, lookup order by rank, confirmed desc, key) as n from i0) where n = 1),
q0 as (select id, owner, case when id // 3 % 4 = 3 then null else {_SPELT.format("(id // 3)")} end as name from p), q1 as (select id, owner, {_REPAIRED.format("name")} as key from q0), q as (select *, {_SKELETON.format("key")} as sk from q1)
select id, q.key as asked, coalesce(a.category, b.category) as category, coalesce(a.confirmed, b.confirmed) as confirmed, coalesce(a."by", b."by") as "by", coalesce(a.key, b.key) as of_key
from q left join i a on a.owner = q.owner and a.lookup = q.key left join i b on b.owner = q.owner and b.lookup = q.sk""")
def k18_party_memory(t, spark, sf_dir):
    """Decisions about parties in sound, damaged and other spellings, looked up by rows in other spellings again; a quarter of the rows has no party."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 40).alias("owner"), F.upper(F.concat("p_name", F.lit(" "), "p_type")).alias("name"), "p_size")
    told = p.where("id % 3 = 0").select("owner", _spelt(F.col("id")).alias("key"), F.concat(F.lit("C"), (F.col("p_size") % 3).cast("string")).alias("category"), "id")
    third = F.floor(F.col("id") / 3)
    rows = p.select("id", "owner", text.repaired(F.when(third % 4 != 3, _spelt(third))).alias("key")).withColumn("skeleton", text.skeleton(F.col("key")))
    hits = memory.lookup(rows, memory.index(memory.decided(told, "owner", "key", "category", ["id"])))
    return hits.select("id", F.col("key").alias("asked"), "hit.category", "hit.confirmed", "hit.by", F.col("hit.key").alias("of_key"))
