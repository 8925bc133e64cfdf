"""Counterparties as entities: the party of a narration, forms of its name, evidence for and against two forms being one
party, and clusters that keep to what people decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.scratch import discard, stored

#: Words of payment rails and of the bank itself, which name no party.
NO_PARTY = (
    "ACH ATM BHIM CARD CHEQUE CHQ CLEARING CLG CR CREDIT DD DEBIT DEP DR EBANK ECS IMPS INB INW MMT MOB MOBILE NACH NEFT NETBANKING OTW P2A P2M POS QR REV RTGS RTN TFR TPT TRANSFER TRF UPI VPA WDL "
    "AC ACC ACCOUNT AMOUNT AND AT BY CHARGES DATE FEE FOR FROM ID INR NO OF ON PAID PAYMENT RECEIVED REF RRN RS THE TO TXN UTR VIA WITH"
).split()
#: Words of a legal form, cut ones of fixed-width files included.
LEGAL = "PVT PRIVATE PRIVAT LTD LIMITED LIMITE LT LLP LLC INC PLC CORP CORPORATION CO COMPANY".split()
#: Words that a firm has in its name and a person hasn't.
TRADES = "AGENCY BANK BROTHER COMMUNICATION ENTERPRISE FINANCE FOOD HOLDING INDIA INDUSTRY INNOVATION INSURANCE LOGISTICS MEDICAL MOTOR SERVICE SOLUTION STORE SUPPLY SYSTEM TECHNOLOGY TRADER TRAVEL".split()

HIGH, MEDIUM = 860, 700


def _once(c: Column, f) -> Column:
    """f of c, which is found once and not again for each use and each element of a lambda in f."""
    return F.get(F.transform(F.array(c), f), 0)


def _digits(w: Column) -> Column:
    return F.length(F.regexp_replace(w, "[^0-9]", ""))


def _letters(w: Column) -> Column:
    return F.length(F.regexp_replace(w, "[^A-Z]", ""))


def party_words(c: Column) -> Column:
    """Words of the party in a narration, in order and once each; empty for null and where there is no party.

    The narration falls into parts at signs; words of rails and banks, references (three digits among letters) and
    numbers of five digits and more name nobody. The part with most letters wins, one that names a bank counts half, and
    a second part goes with it from three quarters of its letters. A digit that looks like a letter is one in a word with
    four times as many letters.
    """
    read = lambda w: F.when((_digits(w) > 0) & (_letters(w) >= _digits(w) * 4), F.translate(w, "01586", "OISBG")).otherwise(w)
    named = lambda w: (w != "") & ~w.isin(NO_PARTY) & ~((_digits(w) >= 3) & (_letters(w) > 0)) & (_digits(w) < 5) & ~w.rlike("^X{2,}[0-9]*$")
    words = lambda p: F.filter(F.transform(F.split(F.regexp_replace(p, "[^A-Z0-9&]+", " "), " "), read), named)
    weigh = lambda ws: F.length(F.regexp_replace(F.array_join(ws, ""), "[^A-Z]", "")) * F.when(F.array_contains(ws, "BANK"), 1).otherwise(2)
    parts = F.transform(F.split(F.upper(F.coalesce(c, F.lit(""))), r"[/\-|:,;*#~]+"), lambda p: F.struct(words(p).alias("ws")))
    parts = F.transform(parts, lambda p: F.struct(weigh(p["ws"]).alias("n"), p["ws"].alias("ws")))
    best = lambda ps: F.array_max(F.transform(ps, lambda p: p["n"]))
    near = _once(parts, lambda ps: _once(best(ps), lambda most: F.slice(F.filter(ps, lambda p: (p["n"] > 2) & (p["n"] * 4 >= most * 3)), 1, 2)))
    return F.array_distinct(F.flatten(F.transform(near, lambda p: p["ws"])))


def party_text(c: Column) -> Column:
    """The words of the party joined by spaces; null where there is none."""
    return F.nullif(F.array_join(party_words(c), " "), F.lit(""))


def singular(w: Column) -> Column:
    """A word of six letters and more without its plural ending."""
    return F.when((F.length(w) >= 6) & w.endswith("IES"), F.regexp_replace(w, "IES$", "Y")).when((F.length(w) >= 6) & w.rlike("[^S]S$"), F.regexp_replace(w, "S$", "")).otherwise(w)


def core_words(words: Column) -> Column:
    """Words without the legal form, plurals as singulars; a name that is nothing but a legal form keeps it."""
    kept = F.filter(words, lambda w: ~w.isin(LEGAL))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(words), singular)


def mentions(df: DataFrame, id: str, name: str, ids: str | None = None) -> DataFrame:
    """id, name, form, words, kind (firm, person or null), ids: what one mention says.

    `form` is the words run together, so that spaces make no difference; null where a name has no party. `ids`: a column
    with an array of identifiers as `kind:value`.
    """
    known = F.coalesce(F.col(ids), F.array().cast("array<string>")) if ids else F.array().cast("array<string>")
    x = df.select(F.col(id).alias("id"), F.col(name).alias("name"), party_words(F.col(name)).alias("said"), known.alias("ids"))
    x = x.withColumn("words", core_words(F.col("said")))
    firm = F.exists("said", lambda w: w.isin(LEGAL)) | F.exists("words", lambda w: w.isin(TRADES))
    person = F.size("words").between(2, 4) & F.forall("words", lambda w: w.rlike("^[A-Z]+$"))
    return x.select("id", "name", F.nullif(F.array_join("words", ""), F.lit("")).alias("form"), "words", F.when(firm, "firm").when(person, "person").alias("kind"), "ids")


def forms(m: DataFrame) -> DataFrame:
    """form, words (of the mention with most of them), kind (null where some mentions say firm and others person), ids, mentions: one row a form.

    The identifiers of a form are gathered once each: as many as a party has, not as it has mentions. Mentions are stored
    first, unless they are: else the words of each narration would be found again for every use of them.
    """
    m = (m if hasattr(m, "scratch_path") else stored(m, "mentions")).where("form is not null")
    best = F.max_by("words", F.struct(F.size("words").alias("n"), F.array_join("words", " ").alias("w")))
    f = m.groupBy("form").agg(best.alias("words"), F.when(F.min("kind") == F.max("kind"), F.min("kind")).alias("kind"), F.count(F.lit(1)).alias("mentions"))
    i = m.select("form", F.explode("ids").alias("i")).distinct().groupBy("form").agg(F.sort_array(F.collect_list("i")).alias("ids"))
    return f.join(i, "form", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))


def _run(form: Column) -> Column:
    """The letters of a form; only one that readings() told apart has spaces."""
    return F.replace(form, F.lit(" "), F.lit(""))


def _inner_ends(words: Column) -> Column:
    """Where words end in their letters run together, but for the last one."""
    return F.slice(_word_ends(words), F.lit(1), F.size(words) - 1)


def _agree(x: Column, y: Column) -> Column:
    """Of the word ends of two, one side's are among the other's: spaces get lost, but they don't move."""
    return (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)


def other_readings(m: DataFrame) -> DataFrame:
    """form, words, reading: other words that end at other places than those of most mentions of the same form; a reading is these words with spaces."""
    x = m.where("form is not null and size(words) > 1").groupBy("form", "words").agg(F.count(F.lit(1)).alias("n"))
    main = x.groupBy("form").agg(F.max_by("words", F.struct("n", F.size("words").alias("w"), F.array_join("words", " ").alias("t"))).alias("main"), F.count(F.lit(1)).alias("all")).where("`all` > 1")
    unlike = ~_agree(_inner_ends(F.col("words")), _inner_ends(F.col("main"))) & (F.sort_array("words") != F.sort_array("main"))
    return x.join(main, "form").where(unlike).select("form", "words", F.array_join("words", " ").alias("reading"))


def readings(m: DataFrame, others: DataFrame) -> DataFrame:
    """Mentions whose words are among `others` (see other_readings) with that reading as their form, so that two names of the same letters stay two."""
    return m.join(others, ["form", "words"], "left").withColumn("form", F.coalesce("reading", "form")).select(*m.columns)


def _numbers(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike("^[0-9]+$"))


def candidates(f: DataFrame, affix: int = 3) -> DataFrame:
    """a, b (a < b): pairs of forms that one kind of evidence could join, each found by a key made for that evidence.

    Equal keys: the same consonants, the same words in any order, one letter left out (so one letter changed, added or
    lost, words in their order or sorted), one identifier; numbers in a name are part of these keys, as no evidence outweighs different numbers. Keys of a
    whole form that meet parts of longer ones: the form itself as a start or end of `affix` letters and more, its two
    longest words as any two words, its letters as first letters of words, its initials beside full words. A pair is
    found by the keys alone: no block of names that merely look alike is compared all with all. The keys of a form take the
    square of its length: it is for names, not for texts.
    """
    x = f.where(F.length("form") >= 3).select("form", _run(F.col("form")).alias("run"), "words", "ids")
    words, n = F.col("words"), F.length("run")
    # what goes into many keys of a form is found once, as columns of its own
    x = x.withColumns({
        "letters": F.regexp_replace("run", "[^A-Z]", ""), "number": F.array_join(F.sort_array(_numbers(words)), ","), "lettered": F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[^A-Z]", "")), lambda w: w != ""),
        "full": F.filter(words, lambda w: F.length(w) >= 4), "sorted_firsts": F.array_join(F.sort_array(F.transform(words, lambda w: F.substring(w, 1, 1))), ""),
    })
    letters, number, lettered, full, sorted_firsts = map(F.col, ("letters", "number", "lettered", "full", "sorted_firsts"))
    key = lambda kind, c: F.concat(F.lit(kind + ":"), c)
    none = F.array().cast("array<string>")
    sure = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    skeleton = text.skeleton(letters)
    # words in order after a letter was left out, so that a misspelt name is found with its words in another order too
    sorted_text = lambda ws: F.array_join(F.sort_array(ws), "")
    without = lambda i: F.transform(F.sequence(F.lit(1), F.length(F.get(lettered, i))), lambda j: sorted_text(F.transform(lettered, lambda w, k: F.when(k == i, F.concat(F.substring(w, F.lit(1), j - 1), F.substring(w, j + 1, F.length(w)))).otherwise(w))))
    ordered = F.when(F.size(lettered) > 1, F.array_append(F.flatten(F.transform(lettered, lambda _, i: without(i))), sorted_text(lettered))).otherwise(F.array().cast("array<string>"))
    less = lambda c: F.array_append(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c), F.lit(1))), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c)))), c)
    both = F.concat(
        F.array(key("S", F.array_join(F.sort_array(words), ""))),
        F.when(F.length(skeleton) >= 2, F.array(key("P", F.concat_ws("#", skeleton, number)))).otherwise(none),
        F.when(F.length(letters) >= 5, F.transform(F.concat(less(letters), ordered), lambda w: key("D", F.concat_ws("#", w, number)))).otherwise(none),
        F.transform("ids", lambda i: key("ID", i)),
    )
    long_first = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    two = F.transform(F.slice(long_first, 1, 2), lambda s: s["w"])
    firsts = F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")
    beside = F.when(F.size(words) >= 2, F.transform(full, lambda w: key("I", F.concat_ws("#", sorted_firsts, text.skeleton(w))))).otherwise(none)
    whole = F.concat(
        F.array(key("A", F.col("run")), key("C", F.array_join(F.sort_array(two), " "))),
        F.when((F.size(words) == 1) & n.between(3, 8), F.array(key("N", F.col("run")))).otherwise(none),
        F.when(F.exists(words, lambda w: F.length(w) == 1), beside).otherwise(none),
    )
    pairs_of_words = F.flatten(F.transform(words, lambda v: F.transform(F.filter(words, lambda w: w >= v), lambda w: F.when(v == w, v).otherwise(F.concat_ws(" ", v, w)))))
    part = F.concat(
        F.flatten(F.transform(F.filter(sure, lambda i: (i >= affix) & (i < n)), lambda i: F.array(key("A", F.substring("run", F.lit(1), i)), key("A", F.substring(F.col("run"), n - i + 1, i))))),
        F.when(F.size(words) >= 2, F.transform(pairs_of_words, lambda w: key("C", w))).otherwise(none),
        F.when(F.size(words) >= 3, F.array(key("N", firsts))).otherwise(none), beside,
    )
    # dealt over all tasks, as a form's keys take far more time than its row has bytes; and not computed within the filter above
    k = stored(x.repartition("form").select("form", F.array_distinct(both).alias("both"), F.array_distinct(whole).alias("whole"), F.array_distinct(part).alias("part")), "name-keys")
    side = lambda *cs: k.select("form", F.explode(F.array_distinct(F.concat(*cs))).alias("key"))
    met = [(side("both"), side("both"), "a < b"), (side("whole"), side("part"), "a <> b")]
    found = [p.withColumnRenamed("form", "a").join(q.withColumnRenamed("form", "b"), "key").where(which).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")) for p, q, which in met]
    return found[0].unionByName(found[1]).distinct()


def _consonants(w: Column) -> Column:
    """The consonants of a word, doubled letters once, an H only in front; equal ones with a vowel between them stay two, other than in a skeleton."""
    return F.regexp_replace(F.regexp_replace(w, r"([A-Z])\1+", "$1"), "[^B-DF-HJ-NP-TV-Z]|(?<!^)H", "")


def _spelt_alike(v: Column, w: Column) -> Column:
    """Two words may be one however many names have them: an initial, a cut end, one vowel of five letters more or less or changed, or the same consonants of four letters."""
    a, b = F.length(v), F.length(w)
    least = F.least(a, b)
    starts = v.startswith(w) | w.startswith(v)
    sound, bare = _consonants(v), F.regexp_replace(v, "[AEIOU]", "")
    return (starts & ((least == 1) | (least >= 4))) | ((least >= 5) & (F.levenshtein(v, w) <= 1) & (bare == F.regexp_replace(w, "[AEIOU]", ""))) | ((least >= 4) & (F.length(sound) >= 2) & (sound == _consonants(w)))


def _alike(v: Column, w: Column) -> Column:
    """Two words may be one: spelt alike, or one letter of five changed."""
    return _spelt_alike(v, w) | ((F.least(F.length(v), F.length(w)) >= 5) & (F.levenshtein(v, w) <= 1))


def _word_ends(words: Column) -> Column:
    """Where the words end in their letters run together."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: F.length(F.array_join(F.slice(words, 1, i), "")))


def known_pairs(decisions: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """a, b, same: decisions (a_name, b_name, same) by the forms of both names, so that one holds for every spelling of them.

    Where a pair was decided both ways, different holds. Names without a party and pairs of one form are left out.
    `others`: what other_readings() finds.
    """
    x = decisions.where("same is not null").select("same", *[core_words(party_words(F.col(f"{p}_name"))).alias(f"{p}_words") for p in "ab"])
    x = x.select("same", *[c for p in "ab" for c in (f"{p}_words", F.nullif(F.array_join(f"{p}_words", ""), F.lit("")).alias(p))])
    for p in "ab" if others is not None else "":
        x = x.join(others.toDF(p, f"{p}_words", "reading"), [p, f"{p}_words"], "left").withColumn(p, F.coalesce("reading", p)).drop("reading")
    return x.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("same").alias("same"))


def pair_scores(f: DataFrame, pairs: DataFrame, known: DataFrame | None = None, affix: int = 3) -> DataFrame:
    """a, b, score (thousandths), confidence, evidence, conflict for each pair of forms.

    Likeness is the mean of common words, trigrams, edit ratio and equal consonants. Evidence lifts the score and never
    lowers it: the same words in another order 960; a start of six letters and more 950 at most; the whole form at an end
    of the other 860 to 960; all words in the other 970, less 60 for each further word; first letters of the other's words
    930; words that differ in spelling only 920, also (as evidence `letter`) where that is a consonant changed, lost or added; a common identifier 950. A firm and a person: times 0.92. Conflicts:
    different numbers, different identifiers of one kind, words on both sides that the other has nothing like, or words
    that end at different places of the letters that both have, take all; a number on one side only takes 150. As an end,
    a form begins with a word of the other, where that has several: names are cut behind, not in front. From 860 confidence is high, from 700 medium, and high if an identifier is
    common. `known` (a, b, same) overrides all, and its pairs are scored even where no evidence found them.
    """
    if known is not None:
        here = known.join(f.select(F.col("form").alias("a")), "a", "left_semi").join(f.select(F.col("form").alias("b")), "b", "left_semi")
        pairs = pairs.select("a", "b").unionByName(here.select("a", "b")).distinct()
    of = lambda p: f.select(F.col("form").alias(p), F.struct("words", "kind", "ids").alias(p + "f"))
    x = pairs.join(of("a"), "a").join(of("b"), "b")
    x = x.select("a", "b", *[F.col(f"{p}f.{c}").alias(f"{p}_{c}") for p in "ab" for c in ("words", "kind", "ids")])
    only = lambda p, q: F.array_except(f"{p}_words", f"{q}_words")
    x = x.withColumns({"common": F.array_intersect("a_words", "b_words"), "a_only": only("a", "b"), "b_only": only("b", "a"), "a_no": _numbers(F.col("a_words")), "b_no": _numbers(F.col("b_words"))})
    unlike = lambda p, q: F.filter(f"{p}_only", lambda v: ~v.rlike("^[0-9]+$") & ~F.exists(f"{q}_only", lambda w: _alike(v, w)))
    x = x.withColumns({"a_run": _run(F.col("a")), "b_run": _run(F.col("b"))})
    a_short = F.length("a_run") <= F.length("b_run")
    side = lambda p, q: F.when(a_short, F.col(p)).otherwise(F.col(q))
    x = x.withColumns({"a_unlike": unlike("a", "b"), "b_unlike": unlike("b", "a"), "short": side("a_run", "b_run"), "long": side("b_run", "a_run")})
    grams = lambda c: F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array(c))
    x = x.withColumns({"a_grams": grams(F.col("a_run")), "b_grams": grams(F.col("b_run")), "a_sound": _consonants(F.col("a_run"))})
    ga, gb, na, nb = F.col("a_grams"), F.col("b_grams"), F.size("a_words"), F.size("b_words")
    longest, ratio = F.length("long"), F.floor(F.length("short") * 1000 / F.length("long"))
    sound = F.col("a_sound")
    like = F.floor(
        (F.size("common") * 1000 / F.size(F.array_union("a_words", "b_words")) + F.size(F.array_intersect(ga, gb)) * 2000 / (F.size(ga) + F.size(gb))
         + (longest - F.levenshtein("a_run", "b_run")) * 1000 / longest + F.when((sound != "") & (sound == _consonants(F.col("b_run"))), 1000).otherwise(0)) / 4
    )
    x = x.withColumns({"short_at": _word_ends(side("a_words", "b_words")), "long_at": _word_ends(side("b_words", "a_words")), "cut": F.length("long") - F.length("short")})
    ends_of = lambda cut: F.filter(F.transform("long_at", lambda i: i - cut), lambda i: (i > 0) & (i < F.length("short")))
    inner = F.filter("short_at", lambda i: i < F.length("short"))
    agree = lambda at: _agree(inner, at)
    starts_with, ends_with = F.col("long").startswith(F.col("short")), F.col("long").endswith(F.col("short"))
    at_word = (F.size("long_at") == 1) | F.array_contains("long_at", F.col("cut")) | (F.col("cut") == 0)
    starts, ends = starts_with & agree(ends_of(F.lit(0))), ends_with & at_word & agree(ends_of(F.col("cut")))
    crossed = (F.length("short") >= affix) & ((starts_with & ~starts & ~ends) | (ends_with & at_word & ~ends & ~starts))
    within = (F.size("a_only") == 0) | (F.size("b_only") == 0)
    one = F.when(na == 1, F.col("b_words")).when(nb == 1, F.col("a_words"))
    firsts = F.array_join(F.transform(one, lambda w: F.substring(w, 1, 1)), "")
    # who cuts words of a name cuts them all: each name with the beginning of a word of the other is no spelling of it
    cut = lambda p, q: F.exists(f"{p}_only", lambda v: (F.length(v) >= 4) & F.exists(f"{q}_only", lambda w: w.startswith(v) & (F.length(w) > F.length(v) + 1)))
    x = x.withColumn("both_cut", cut("a", "b") & cut("b", "a"))
    spelt = (F.size("a_unlike") == 0) & (F.size("b_unlike") == 0) & (na == nb) & (F.size("a_only") == F.size("b_only")) & ~F.col("both_cut")
    letter = lambda p, q: F.exists(f"{p}_only", lambda v: ~v.rlike("^[0-9]+$") & ~F.exists(f"{q}_only", lambda w: _spelt_alike(v, w)))
    x = x.withColumn("by_a_letter", letter("a", "b") | letter("b", "a"))
    sure = (F.size("common") > 0) | F.forall(F.concat("a_only", "b_only"), lambda w: F.length(w) >= 4)
    shared = F.arrays_overlap("a_ids", "b_ids")
    same = {
        "words": F.when((F.size("a_only") == 0) & (F.size("b_only") == 0), 960), "start": F.when(starts & (F.length("short") >= 6), F.floor(F.least(ratio + 250, F.lit(1000)) * 950 / 1000)),
        "end": F.when((starts | ends) & (F.length("short") >= affix), 860 + F.floor(ratio / 10)), "within": F.when(within & (F.length("short") >= 4), F.greatest(970 - 60 * F.abs(na - nb), F.lit(500))),
        "initials": F.when((F.length("short") >= 3) & (F.size(one) >= 2) & (firsts == F.col("short")), 930), "spelling": F.when(spelt & sure & ~F.col("by_a_letter"), 920), "letter": F.when(spelt & sure & F.col("by_a_letter"), 920), "identifier": F.when(shared, 950), "likeness": like,
    }
    x = x.withColumns({f"by_{k}": v.cast("long") for k, v in same.items()})
    x = x.withColumn("best", F.array_max(F.array_compact(F.array(*[F.when(F.col(f"by_{k}").isNotNull(), F.struct(F.col(f"by_{k}").alias("n"), F.lit(k).alias("why"))) for k in same]))))
    kinds = lambda c: F.array_distinct(F.transform(c, lambda i: F.substring_index(i, ":", 1)))
    kept = lambda p, k: F.filter(f"{p}_ids", lambda i: F.substring_index(i, ":", 1) == k)
    apart = F.exists(F.array_intersect(kinds("a_ids"), kinds("b_ids")), lambda k: ~F.arrays_overlap(kept("a", k), kept("b", k)))
    n_a, n_b = F.size("a_no"), F.size("b_no")
    conflict = (
        F.when((n_a > 0) & (n_b > 0) & ~F.arrays_overlap("a_no", "b_no"), "numbers").when(apart, "identifiers").when((F.size("a_unlike") > 0) & (F.size("b_unlike") > 0) & (F.size("common") > 0), "words").when(crossed, "word ends").when((n_a > 0) != (n_b > 0), "number")
    )
    typed = F.when(F.col("a_kind") != F.col("b_kind"), F.floor(F.col("best.n") * 92 / 100)).otherwise(F.col("best.n"))
    x = x.select("a", "b", F.col("best.why").alias("evidence"), conflict.alias("conflict"), typed.alias("n"), shared.alias("shared"))
    score = F.when(F.col("conflict").isNull(), F.col("n")).when(F.col("conflict") == "number", F.greatest(F.col("n") - 150, F.lit(0))).otherwise(0)
    x = x.withColumn("score", score.cast("long"))
    x = x.withColumn("confidence", F.when((F.col("score") >= HIGH) | ((F.col("score") >= MEDIUM) & F.col("shared")), "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low"))
    if known is None:
        return x.select("a", "b", "score", "confidence", "evidence", "conflict")
    x = x.join(known, ["a", "b"], "left")
    said = lambda yes, no, c: F.when(F.col("same"), yes).when(~F.col("same"), no).otherwise(F.col(c)).alias(c)
    return x.select("a", "b", said(F.lit(1000).cast("long"), F.lit(0).cast("long"), "score"), said("high", "low", "confidence"), said("decided", "decided", "evidence"), said(F.lit(None).cast("string"), F.lit("decided"), "conflict"))


def clusters(f: DataFrame, links: DataFrame, apart: DataFrame | None = None, settled: DataFrame | None = None) -> DataFrame:
    """form, entity (its smallest form): clusters grown over `links` (a, b, score) by falling score, never across `apart` (a, b).

    The result is that of taking links one by one, highest score first (of equals the smaller a, then b), each joining the
    clusters of its ends unless any form of one is kept apart from any of the other. All of these are taken at once in a
    round: a link that is the best left of both its clusters, and one that is the best of a cluster that no pair of
    `apart` names, as nothing that comes before it can touch either. Without `apart` the clusters of a round at least
    halve those that can still grow; pairs of `apart` can add rounds, as many as decided names one name is linked with.
    `settled` (form): each two of these are kept apart as well, without their pairs being written down.
    """
    order = lambda: F.struct((-F.col("score")).alias("s"), F.col("ea"), F.col("eb"))
    both = lambda d, *more: d.select("a", "b", *more).unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))
    labels = stored(f.select("form", F.col("form").alias("entity")), "entities")
    edges = stored(both(links.select("a", "b", "score", F.least("a", "b").alias("ea"), F.greatest("a", "b").alias("eb")), "score", "ea", "eb"), "entity-links")
    walls = stored(both(apart if apart is not None else links.select("a", "b").limit(0)).distinct(), "entity-walls")
    held = None if settled is None else stored(settled.select(F.col("form").alias("a")).distinct(), "entities-settled")
    while True:
        free = edges.join(walls, ["a", "b"], "left_anti")
        if held is not None:
            no = lambda c: held.select(F.col("a").alias(c), F.lit(True).alias(f"{c}_held"))
            free = free.join(no("a"), "a", "left").join(no("b"), "b", "left").where("a_held is null or b_held is null")
        top = free.groupBy("a").agg(F.min_by("b", order()).alias("b"), F.min(order()).alias("o"))
        top = stored(top, "best-links")
        if top.isEmpty():
            break
        bound = (walls.select("a") if held is None else walls.select("a").unionByName(held)).distinct().withColumn("bound", F.lit(True))
        other = top.select(F.col("a").alias("b"), F.col("o").alias("theirs"))
        taken = top.join(other, "b").join(bound, "a", "left").where("bound is null or o = theirs")
        # one way out of each cluster: two that chose each other stop at the smaller one
        to = taken.where((F.col("o") != F.col("theirs")) | (F.col("a") > F.col("b"))).select("a", F.col("b").alias("to"))
        to = stored(to, "ways")
        while True:
            # the way of one's way, which halves what is left of it
            on = to.join(to.select(F.col("a").alias("to"), F.col("to").alias("further")), "to", "left").select("a", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
            on = stored(on, "ways")
            moved = not on.where("moved").isEmpty()
            discard(to)
            to = on.drop("moved")
            to.scratch_path = on.scratch_path
            if not moved:
                break
        name = lambda d, c: d.join(to.select(F.col("a").alias(c), "to"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
        new_labels = stored(name(labels, "entity").select("form", "entity"), "entities")
        new_edges = stored(name(name(edges, "a"), "b").where("a <> b").groupBy("a", "b").agg(F.min(order()).alias("o")).select("a", "b", (-F.col("o.s")).alias("score"), "o.ea", "o.eb"), "entity-links")
        new_walls = stored(name(name(walls, "a"), "b").select("a", "b").distinct(), "entity-walls")
        new_held = None if held is None else stored(name(held, "a").distinct(), "entities-settled")
        discard(labels, edges, walls, top, to, *([] if held is None else [held]))
        labels, edges, walls, held = new_labels, new_edges, new_walls, new_held
    least = labels.groupBy("entity").agg(F.min_by("form", F.struct(_run(F.col("form")).alias("r"), "form")).alias("least"))
    return labels.join(least, "entity").select("form", F.col("least").alias("entity"))


def suggestions(scored: DataFrame, c: DataFrame) -> DataFrame:
    """a_entity, b_entity, score, evidence: the best medium pair between two different entities, for a person to decide."""
    of = lambda p: c.select(F.col("form").alias(p), F.col("entity").alias(f"{p}_entity"))
    x = scored.where("confidence = 'medium'").join(of("a"), "a").join(of("b"), "b").where("a_entity <> b_entity")
    x = x.select(F.least("a_entity", "b_entity").alias("a_entity"), F.greatest("a_entity", "b_entity").alias("b_entity"), "score", "evidence")
    return x.groupBy("a_entity", "b_entity").agg(F.max("score").alias("score"), F.max_by("evidence", F.struct("score", "evidence")).alias("evidence"))


def without_letters_of_settled(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scored pairs without those of two settled names a consonant apart; the settled names (form).

    A name is settled if evidence other than a letter or mere likeness, high or medium, joins it to another. Two such names that
    are a letter apart are two names, each written in that way again and again; a letter is a slip only where one name has nothing else.
    """
    x = scored.where("confidence <> 'low' and evidence not in ('letter', 'likeness')")
    settled = stored(x.select(F.explode(F.array("a", "b")).alias("form")).distinct(), "settled-names")
    of = lambda p: settled.select(F.col("form").alias(p), F.lit(True).alias(f"{p}_settled"))
    letters = scored.where("evidence = 'letter'").join(of("a"), "a", "left").join(of("b"), "b", "left").where("a_settled is null or b_settled is null").select(*scored.columns)
    return scored.where("evidence <> 'letter'").unionByName(letters), settled


def resolve(df: DataFrame, id: str, name: str, ids: str | None = None, decisions: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Mentions (id, name, form, entity), entities (entity, name, forms, mentions) and suggestions.

    A mention without a party has no form and no entity. Mentions of the same letters whose words end at different places are
    of different entities; one whose smallest form is another's too goes by its words. An entity goes by its form with most mentions, of equals by
    that with more words, then the smaller one.
    """
    m = stored(mentions(df, id, name, ids), "mentions")
    others = stored(other_readings(m), "other-readings")
    others = None if others.isEmpty() else others
    m = m if others is None else stored(readings(m, others), "mentions")
    f = stored(forms(m), "forms")
    known = None if decisions is None else stored(known_pairs(decisions, others), "decided-names")
    scored = stored(pair_scores(f, candidates(f), known), "name-pairs")
    kept, settled = without_letters_of_settled(scored)
    scored = stored(kept, "name-pairs")
    # a cut name can be the start of two; those whose words end at different places stay apart, whatever lies between them
    apart = scored.where("conflict = 'word ends'").select("a", "b")
    apart = apart if known is None else apart.unionByName(known.where("not same").select("a", "b"))
    high = scored.where("confidence = 'high'")
    c = stored(clusters(f, high.where("evidence <> 'letter'"), apart), "entities-of-forms")
    # slips of a letter come last, and join no two clusters of settled names
    slips = high.where("evidence = 'letter'")
    if not slips.isEmpty():
        of = lambda p: c.select(F.col("form").alias(p), F.col("entity").alias(f"{p}_entity"))
        between = lambda d, *more: d.join(of("a"), "a").join(of("b"), "b").select(F.least("a_entity", "b_entity").alias("a"), F.greatest("a_entity", "b_entity").alias("b"), *more).where("a <> b")
        ends = between(slips, "score").groupBy("a", "b").agg(F.max("score").alias("score"))
        whole = clusters(c.select(F.col("entity").alias("form")).distinct(), ends, between(apart), c.join(settled, "form").select(F.col("entity").alias("form")))
        c = stored(c.join(whole.toDF("entity", "whole"), "entity").select("form", F.col("whole").alias("entity")), "entities-of-forms")
    if others is not None:
        # a second reading's spaces are shown only where the form alone is the name of another entity
        plain = c.select(_run(F.col("entity")).alias("plain"), "entity").distinct().groupBy("plain").agg(F.min("entity").alias("entity"), F.count(F.lit(1)).alias("n")).where("n = 1 and entity <> plain").drop("n")
        c = stored(c.join(plain, "entity", "left").select("form", F.coalesce("plain", "entity").alias("entity")), "entities-of-forms")
    best = F.min_by(F.array_join("words", " "), F.struct((-F.col("mentions")).alias("m"), (-F.size("words")).alias("w"), "form"))
    e = f.join(c, "form").groupBy("entity").agg(best.alias("name"), F.count(F.lit(1)).alias("forms"), F.sum("mentions").alias("mentions"))
    return m.join(c, "form", "left").select("id", "name", _run(F.col("form")).alias("form"), "entity"), e, suggestions(scored, c)
