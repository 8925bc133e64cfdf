"""Queries over parties of narrations and names as entities, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import query
from .operators import resolution
from .plans.ledger import read
from .plans.scratch import stored

_IN = "({})".format(", ".join(f"'{w}'" for w in resolution.NO_PARTY))
_DIGITS, _LETTERS = "length(regexp_replace(w, '[^0-9]', '', 'g'))", "length(regexp_replace(w, '[^A-Z]', '', 'g'))"


@query(f"""+ s as (select txn_id, generate_subscripts(ps, 1) as i, unnest(ps) as p from (select txn_id, regexp_split_to_array(upper(narration), '[/|:,;*#~-]+') as ps from txn)),
w0 as (select txn_id, i, generate_subscripts(ws, 1) as j, unnest(ws) as w from (select txn_id, i, regexp_split_to_array(regexp_replace(p, '[^A-Z0-9&]+', ' ', 'g'), ' ') as ws from s)),
w1 as (select txn_id, i, j, case when {_DIGITS} > 0 and {_LETTERS} >= 4 * {_DIGITS} then translate(w, '01586', 'OISBG') else w end as w from w0),
w2 as (select * from w1 where w <> '' and w not in {_IN} and not ({_DIGITS} >= 3 and {_LETTERS} > 0) and {_DIGITS} < 5 and not regexp_full_match(w, 'X{{2,}}[0-9]*')),
g as (select txn_id, i, sum({_LETTERS}) * case when bool_or(w = 'BANK') then 1 else 2 end as n from w2 group by 1, 2),
h as (select *, max(n) over (partition by txn_id) as best from g), k as (select txn_id, i, row_number() over (partition by txn_id order by i) as r from h where n > 2 and n * 4 >= best * 3),
o as (select txn_id, w, min(i * 1000 + j) as pos from w2 join k using (txn_id, i) where r <= 2 group by 1, 2), q as (select txn_id, string_agg(w, ' ' order by pos) as party from o group by 1)
select txn_id, party from txn left join q using (txn_id)""")
def e1_party_text(t, spark, sf_dir):
    return t.select("txn_id", resolution.party_text(F.col("narration")).alias("party"))


def _syllables(number):
    """A word of a syllable for each digit."""
    out = number
    for digit, s in enumerate(("ba", "ke", "di", "fo", "gu", "la", "me", "ni", "po", "ru")):
        out = F.replace(out, F.lit(str(digit)), F.lit(s))
    return F.upper(out)


def _spelt(spark, sf_dir):
    """A mention for each part: eight spellings of each of the firms, whose names follow from the key."""
    k = F.floor(F.col("p_partkey") / 8).cast("long")
    digits = lambda by, n: F.lpad((k * by % 10**n).cast("string"), n, "0")
    p = read(spark, sf_dir, "part").select("p_partkey", k.alias("k"), _syllables(digits(7919, 6)).alias("v"), _syllables(digits(1237, 4)).alias("w"))
    ref, say = F.lpad("p_partkey", 11, "0"), F.concat
    kinds = [
        say("v", F.lit(" "), "w", F.lit(" PVT LTD")), say(F.lit("NEFT-YESB"), ref, F.lit("-"), "v", F.lit(" "), "w", F.lit(" PRIVATE LIMITED")), say("v", "w"), say(F.lit("UPI/"), ref, F.lit("/"), "w", F.lit(" "), "v", F.lit("/AXIS BANK")),
        F.substring(say("v", "w"), 1, 14), say(F.substring("v", 1, 3), F.substring("v", 5, 20), F.lit(" "), "w"), say("v", F.lit(" "), "w", F.lit(" INDIA")), say("v", F.lit(" "), F.substring("w", 1, 1)),
    ]
    name = F.element_at(F.array(*kinds), (F.col("p_partkey") % 8 + 1).cast("int"))
    return p.select(F.col("p_partkey").alias("id"), "k", name.alias("name"), say("v", F.lit(" "), "w").alias("firm"))


def _word_sql(by, n):
    out = f"lpad((k * {by} % {10**n})::varchar, {n}, '0')"
    for digit, s in enumerate(("ba", "ke", "di", "fo", "gu", "la", "me", "ni", "po", "ru")):
        out = f"replace({out}, '{digit}', '{s}')"
    return f"upper({out})"


#: The SQL knows which spellings belong together; the query has to find it out.
_SPELT = f"""k0 as (select p_partkey as id, p_partkey // 8 as k from part), k1 as (select *, {_word_sql(7919, 6)} as v, {_word_sql(1237, 4)} as w from k0),
k2 as (select id, k, case id % 8 when 3 then w || v when 4 then substr(v || w, 1, 14) when 5 then substr(v, 1, 3) || substr(v, 5) || w when 6 then v || w || 'INDIA' when 7 then v || substr(w, 1, 1) else v || w end as form from k1)"""


@query(f"{_SPELT} select id, form, min(form) over (partition by k) as entity from k2", base="")
def e10_entities(t, spark, sf_dir):
    return resolution.resolve(_spelt(spark, sf_dir), "id", "name")[0].select("id", "form", "entity")


@query(f"{_SPELT}, g as (select *, case when k % 10 = 1 then k - 1 else k end as g from k2) select id, form, min(form) over (partition by g) as entity from g", base="")
def e14_entities_by_decisions(t, spark, sf_dir):
    n = _spelt(spark, sf_dir)
    firms = n.groupBy("k").agg(F.min("firm").alias("firm"))
    # each tenth firm is the one after it, as somebody said; the next two are not
    after = lambda m, same: firms.where(F.col("k") % 10 == m).select(F.col("k") + 1, F.col("firm").alias("a_name")).toDF("k", "a_name").join(firms.withColumnRenamed("firm", "b_name"), "k").select("a_name", "b_name", F.lit(same).alias("same"))
    return resolution.resolve(n, "id", "name", decisions=after(0, True).unionByName(after(2, False)))[0].select("id", "form", "entity")


@query()
def e8_name_scores(t, spark, sf_dir):
    m = stored(resolution.mentions(_spelt(spark, sf_dir), "id", "name"), "mentions")
    f = stored(resolution.forms(resolution.readings(m, stored(resolution.other_readings(m), "other-readings"))), "forms")
    return resolution.pair_scores(f, resolution.candidates(f))


@query(f"""k0 as (select p_partkey as id, p_partkey // 4 as k from part), k1 as (select *, {_word_sql(7919, 6)} || {_word_sql(1237, 4)} as form from k0)
select distinct a.form as a_entity, b.form || (b.id % 4 - 1) as b_entity, 805::bigint as score, 'end' as evidence from k1 a join k1 b using (k) where a.id % 4 < 2 and b.id % 4 > 1""", base="")
def e12_branch_suggestions(t, spark, sf_dir):
    k = F.floor(F.col("p_partkey") / 4).cast("long")
    digits = lambda by, n: F.lpad((k * by % 10**n).cast("string"), n, "0")
    firm = F.concat(_syllables(digits(7919, 6)), F.lit(" "), _syllables(digits(1237, 4)), F.lit(" LTD"))
    kind, ref = F.col("p_partkey") % 4, F.lpad("p_partkey", 11, "0")
    name = F.when(kind == 0, firm).when(kind == 1, F.concat(F.lit("NEFT-YESB"), ref, F.lit("-"), firm)).otherwise(F.concat(firm, F.lit(" "), (kind - 1).cast("string")))
    return resolution.resolve(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), name.alias("name")), "id", "name")[2]
