"""Decisions about parties: repaired and tolerant spellings, shapes, guards of skeletons, owners, what a hit replaces."""

import re

from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import memory


def _hits(spark, decisions, asked):
    """(category, by) of each asked (owner, narration) after decisions (owner, narration, category) in order."""
    told = spark.createDataFrame([(i, *d) for i, d in enumerate(decisions)], "i int, owner string, said string, category string").withColumn("k", memory.keys(F.col("said"))).select("i", "owner", "k.key", "category")
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "i int, owner string, said string").withColumn("k", memory.keys(F.col("said"))).select("i", "owner", "said", "k.*")
    out = memory.lookup(rows, memory.index(memory.decided(told, "owner", "key", "category", ["i"])))
    got = {r.i: (r.hit.category, r.hit.by, r.hit.confirmed) if r.hit else None for r in out.collect()}
    assert len(got) == out.count() == len(asked)
    return [got[i] for i in range(len(asked))]


def test_repaired_and_tolerant(spark):
    cases = {"W1B": "WIB", "1NT": "INT", "5U5HM1THA H SHETTY": "SUSHMITHA H SHETTY", "AXNPN09200047279": "AXNPN09200047279", "5091357116": "5091357116", "C011": "C011", "": "", None: None, "a/b0y-8": "A/BOY-8", "BT25040124001012": "BT25040124001012"}
    df = spark.createDataFrame([(k,) for k in cases], "c string")
    assert {r.c: r.x for r in df.select("c", text.repaired(F.col("c")).alias("x")).collect()} == cases
    for word, scanned in (("coll", "C011"), ("MARUTHI", "MARUTH1"), ("LOAN", "1OAN"), ("BOSS", "8055")):
        assert re.fullmatch(text.tolerant(word), scanned)
    said = spark.createDataFrame([("1NT.C011 x",), ("XC011",), (None,), ("PLAIN COLL",)], "c string").select(text.says(F.col("c"), "coll", "rent").alias("x"))
    assert [r.x for r in said.collect()] == [True, False, None, True]


def test_decisions_carry_over_spellings_and_shapes(spark):
    told = [("u", "EBANK:WIB/1/SUSHMITHA H SHETTY", "Rent"), ("u", "SERVICE CHARGE FOR JUNE 2026", "Fees"), ("u", "NEFT-HDFCH25081234567-MEYER ORGANICS PVT LTD", "Goods"), ("u", "A00021802260044311", "Fees"), ("u", None, "Fees"), ("u", "KUMAR FISH", None)]
    asked = [("u", "EBANK:WIB/77/SUSHMITA H SHETTY"), ("u", "EBANK:W1B/8/5U5HM1THA H SHETTY"), ("u", "SERVICE CHARGE FOR SEPTEMBER 2026"), ("u", "SERVICE TAX PAYMENT 4402"), ("u", "RTGS-ICIC99-MEYER ORGANICS PRIVATE LIMITED"), ("v", "RTGS-ICIC99-MEYER ORGANICS PRIVATE LIMITED"), ("u", "A00021802260044311"), ("u", None), (None, "KUMAR FISH"), ("u", "KUMAR FISH")]
    got = _hits(spark, told, asked)
    assert got == [("Rent", "skeleton", 1), ("Rent", "exact", 1), ("Fees", "exact", 1), None, ("Goods", "exact", 1), None, None, None, None, None]


def test_a_correction_holds_at_once(spark):
    told = [("u", f"EBANK:WIB/{i}/KUMAR FISH", c) for i, c in enumerate(["Goods", "Goods", "Goods", "Food"])]
    assert _hits(spark, told, [("u", "KUMAR FISH")]) == [("Food", "exact", 1)]
    assert _hits(spark, told[:3], [("u", "KUMAR FISH")]) == [("Goods", "exact", 3)]


def test_skeletons_must_be_long_and_agree(spark):
    mem = lambda rows: spark.createDataFrame(rows, "owner string, key string, category string, confirmed long")
    idx = lambda rows: {r.lookup: (r.hit.category, r.hit.key, r.hit.by) for r in memory.index(mem(rows)).collect()}
    agree = idx([("u", "NARASIMHA CHIKEN", "a", 1), ("u", "NARASIMHAIAH CHIKEN", "a", 5), ("u", "ABC", "b", 9)])
    bones = (set(agree) - {"NARASIMHA CHIKEN", "NARASIMHAIAH CHIKEN", "ABC"}).pop()
    assert agree[bones] == ("a", "NARASIMHAIAH CHIKEN", "skeleton") and len(agree) == 4
    assert len(idx([("u", "NARASIMHA CHIKEN", "a", 1), ("u", "NARASIMHAIAH CHIKEN", "b", 5)])) == 2
    # a stored damaged key is found in repaired spelling, but never instead of a decision of just that spelling
    damaged = idx([("u", "5U5HMA", "a", 9), ("u", "SUSHMA", "b", 1)])
    assert (damaged["SUSHMA"], damaged["5U5HMA"]) == (("b", "SUSHMA", "exact"), ("a", "5U5HMA", "exact"))
    assert idx([("u", "5U5HMA", "a", 9)])["SUSHMA"] == ("a", "5U5HMA", "repaired")
    assert idx([]) == {}


def test_group_keys(spark):
    k = spark.createDataFrame([("RESILIENTINNOVA",), ("RESILIENT INNOVATIONS PRIVAT",), ("ABC",), ("SERVICE CHARGE FOR JUNE",)], "c string").withColumn("k", memory.keys(F.col("c"))).select("k.*")
    a, b, short, shape = [r.g for r in k.select(memory.group_key(F.col("kind"), F.col("key"), F.col("skeleton")).alias("g")).collect()]
    assert a == b and (short, shape) == ("ABC", "SERVICE CHARGE FOR")


def test_what_a_hit_replaces(spark):
    rows = [(1, "x", "none", True, "m"), (2, "x", "trade_name:FISH", False, "m"), (3, "x", "tax:GST", False, "m"), (4, "x", "none", True, None), (5, "x", None, None, "m")]
    df = spark.createDataFrame(rows, "id int, category string, rule string, requires_review boolean, c string").withColumn("hit", F.when(F.col("c").isNotNull(), F.struct(F.col("c").alias("category")))).drop("c")
    got = {r.id: (r.category, r.rule, r.requires_review) for r in memory.carried(df).collect()}
    assert got == {1: ("m", "memory", False), 2: ("m", "memory", False), 3: ("x", "tax:GST", False), 4: ("x", "none", True), 5: ("x", None, None)}
