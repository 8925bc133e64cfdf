"""Source divergence audit by wide term vectors.

Terms are counted by language and source; each kept term of a language becomes an array indexed by the
language's sources. Higher-order functions turn an array of counts into smoothed shares and a share and
the array into its contributions to all pairs of sources, which partial sums add before any shuffle.
Terms with the same counts share one array and a multiplicity; a pair's terms that neither source has
contribute one value each, which is taken times their number. Only DataFrame functions; all integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: What stands between terms.
BREAK = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SCALE = 1_000_000_000


def ascii_lower(text: Column) -> Column:
    """A-Z alone lower-cased; texts of one byte a character take the faster way, which is the same for them."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 1) / (n + v)), exact: by decimals where the product is beyond a long."""
    wide = F.lit(_SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(19,0)")
    small = F.call_function("div", F.lit(_SCALE).cast("long") * (count + 1), n + v)
    return 1 + F.when(count < 9_000_000_000, small).otherwise(F.call_function("div", wide, (n + v).cast("decimal(19,0)")))


def gain(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows with the term)."""
    rows = docs.select("lang", "source", F.split(ascii_lower(F.col("text")), BREAK).alias("terms"))
    # all occurrences, then the row's distinct terms: one pass over the text, one aggregation
    both = F.explode(F.array(F.struct(F.lit(0).alias("once"), F.col("terms")), F.struct(F.lit(1).alias("once"), F.array_distinct("terms").alias("terms"))))
    rows = rows.select("lang", "source", both.alias("x")).select("lang", "source", "x.once", F.explode("x.terms").alias("term")).where("term != ''")
    return rows.groupBy("lang", "source", "term").agg(F.sum(1 - F.col("once")).alias("n"), F.sum("once").cast("long").alias("docs"))


def audit(documents: DataFrame, least_docs: int = 3, most_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from the others of its language, and by which terms.

    Null text, lang and source are ''. A language keeps the terms of at least `least_docs` of its rows
    (repeated rows count each). Part `pair` has every other source of the language by falling value,
    part `term` the `most_terms` terms of most value that the source uses more than its language does;
    equal values go by the item's bytes. A language with one source has no pairs, one without kept terms
    pairs of value 0; an empty table gives no rows. Other columns are not looked at.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    docs = documents.select(blank("lang"), blank("source"), blank("text"))
    index = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = stored(docs.select("lang", "source").distinct().withColumn("s", index), "divergence-groups")
    counts = stored(term_counts(docs), "divergence-counts")
    entries = F.array_sort(F.collect_list(F.struct("s", "n")))
    kept = counts.join(groups, ["lang", "source"]).groupBy("lang", "term").agg(F.sum("docs").alias("docs"), entries.alias("at"))
    kept = stored(kept.where(F.col("docs") >= least_docs).select("lang", "term", "at"), "divergence-terms")

    # a row for each language: its sources' totals in the order of their index, its own total, its number of terms
    sums = kept.select("lang", F.explode("at").alias("x")).groupBy("lang", F.col("x.s").alias("s")).agg(F.sum("x.n").alias("n"))
    totals = groups.join(sums, ["lang", "s"], "left").groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("s", F.coalesce("n", F.lit(0)).alias("n")))).alias("by"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    langs = totals.join(sizes, "lang").select("lang", F.col("by.n").alias("ns"), F.aggregate("by", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), "v")
    langs = langs.withColumn("none", F.transform("ns", lambda n: share(F.lit(0).cast("long"), n, F.col("v"))))
    langs = stored(langs, "divergence-langs")

    alike = kept.groupBy("lang", "at").agg(F.count(F.lit(1)).alias("times")).join(langs, "lang")
    # source-indexed counts, then shares; most shares are those of no occurrence, whose pairs need no sum but a number
    wide = alike.withColumn("m", F.map_from_entries("at")).select("lang", "times", "none", F.transform("ns", lambda n, i: share(F.coalesce(F.col("m")[i], F.lit(0)), n, F.col("v"))).alias("ps"))
    own = wide.select("lang", "times", "none", "ps", F.posexplode("ps").alias("s", "p")).where("p != none[s]")
    both = F.transform("ps", lambda q, o: F.struct(gain(F.col("p"), q).alias("f"), F.when(q == F.col("none")[o], gain(q, F.col("p"))).alias("back")))
    each = own.select("lang", "s", "times", F.posexplode(both).alias("o", "x")).where("s != o")
    times = F.col("times")
    sums = [F.sum(F.col("x.f") * times).alias("f"), F.sum(times).alias("n"), F.sum(F.col("x.back") * times).alias("back"), F.sum(F.when(F.col("x.back").isNotNull(), times)).alias("m")]
    summed = stored(each.groupBy("lang", "s", "o").agg(*sums), "divergence-pairs")
    others = groups.select("lang", F.col("source").alias("item"), F.col("s").alias("o"))
    turned = summed.select("lang", F.col("s").alias("o"), F.col("o").alias("s"), "back", "m")
    pairs = groups.join(others, "lang").where("s != o").join(summed.select("lang", "s", "o", "f", "n"), ["lang", "s", "o"], "left").join(turned, ["lang", "s", "o"], "left").join(langs.select("lang", "none", "v"), "lang", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    value = zero("f") + zero("back") + (F.col("v") - zero("n") - zero("m")) * gain(F.col("none")[F.col("s")], F.col("none")[F.col("o")])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", zero(value).cast("long").alias("value"))

    whole = F.aggregate("at", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    used = kept.withColumn("whole", whole).join(langs, "lang").select("lang", "term", share(F.col("whole"), F.col("n"), F.col("v")).alias("q"), "ns", "v", F.explode("at").alias("x"))
    used = used.select("lang", F.col("x.s").alias("s"), "term", share(F.col("x.n"), F.col("ns")[F.col("x.s")], F.col("v")).alias("p"), "q").where("p > q")
    used = used.select("lang", "s", F.col("term").alias("item"), gain(F.col("p"), F.col("q")).alias("value"))
    first = Window.partitionBy("lang", "s").orderBy(F.desc("value"), "item")
    terms = used.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= most_terms)
    terms = terms.join(groups, ["lang", "s"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)
