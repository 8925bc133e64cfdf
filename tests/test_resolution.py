"""Entities: parties of narrations, evidence and conflicts of two names, clusters against links taken one by one."""

import random

import pytest

from pyspark.sql import functions as F

from ledgerloom.operators import resolution as R


def entities(spark, names, decisions=None, ids=None):
    df = spark.createDataFrame([(i, n, (ids or {}).get(i)) for i, n in enumerate(names)], "id long, name string, ids array<string>")
    d = None if decisions is None else spark.createDataFrame(decisions, "a_name string, b_name string, same boolean")
    m, e, s = R.resolve(df, "id", "name", "ids", d)
    return {r.id: r.entity for r in m.collect()}, e.collect(), s.collect()


def groups(spark, names, **more):
    """The names that are one entity, by their places."""
    of, _, _ = entities(spark, names, **more)
    return sorted(sorted(i for i in of if of[i] == e) for e in {v for v in of.values() if v is not None})


def test_parties(spark):
    said = {
        "UPI UPI RAMACHANDRAKOTHARI": "RAMACHANDRAKOTHARI", "NEFT-YESB43340764058-RESILIENT INNOVATIONS PVT LTD": "RESILIENT INNOVATIONS PVT LTD", "IMPS/123456/ABC TRADERS": "ABC TRADERS",
        "RTGS/UTR9988776655/ACME INDUSTRIES/HDFC BANK": "ACME INDUSTRIES", "NEFT-KKBK0000123456789-ZQXWV HOLDINGS PVT LTD-KOTAK BANK": "ZQXWV HOLDINGS PVT LTD", "BT2504/5091357116/79707/B0BCARD L": "BOBCARD L",
        "EBANK:W1B/1451818217/07:22:38": "W1B", "": None, "UPI/123456789/": None, "  ": None,
    }
    df = spark.createDataFrame([(k,) for k in said] + [(None,)], "x string")
    got = {r.x: r.p for r in df.select("x", R.party_text(df.x).alias("p")).collect()}
    assert got.pop(None) is None
    assert {k: v for k, v in got.items() if not k.startswith("EBANK")} == {k: v for k, v in said.items() if not k.startswith("EBANK")}
    assert "07" not in (got["EBANK:W1B/1451818217/07:22:38"] or "")


ONE = [
    ["Ramachandra Kothari", "Ramachandrakothari", "UPI UPI Ramachandrakothari", "NEFT-Ramachandra Kothari", "Ramachandra  Kothari"], ["ABC PVT LTD", "ABC PRIVATE LIMITED", "ABC PRIVATE LTD", "NEFT-ABC PVT LTD", "ABC PVT. LTD."],
    ["NEFT-YESB4334-RESILIENT INNOVATIONS PVT LT", "RESILIENT INNOVATIONS PVT LTD", "RESILIENTINNOVA"], ["B M CHETAN", "CHETHAN B M"], ["MANOJ NATH GOSWAMI", "MANOJ N GOSWAMI", "MANOJNATHGOSWAMI"],
    ["KERLETTA", "KERKETTA"], ["MUSHROOM", "MASHRROM"], ["Eugin", "Eugine"], ["STATE BANK INDIA", "SBI"], ["ACME Technologies", "ACME Technologies India"],
]
APART = [("LAKME BROTHERS", "LAKME ENTERPRISES"), ("COASTAL SRIRAM", "COASTAL GAYADI"), ("SUNRISE STORE 1", "SUNRISE STORE 2")]


def test_one_party_written_in_many_ways_and_parties_that_stay_apart(spark):
    names = [n for g in ONE for n in g] + [n for g in APART for n in g]
    want, at = [], 0
    for g in ONE:
        want.append(list(range(at, at + len(g))))
        at += len(g)
    want += [[i] for i in range(at, len(names))]
    assert groups(spark, names) == sorted(want)


def test_ends_in_the_middle_of_words_and_other_consonants_do_not_join_names(spark):
    # begins in the middle of a word of the other; a start of both whose words end elsewhere; consonants that only a skeleton has as one
    names = ["BARUDIPODIDIBA", "NIBAMEBA RUDIPODIDIBA", "NIBAMEBARUDI P", "NIBAMEBARUDIPO", "NIBAMEBARUDI PORUKEME", "DIFOFOMEKEKEBA", "DIFOMEKEBABABA"]
    assert groups(spark, names) == [[0], [1], [2, 3, 4], [5], [6]]
    # a letter left out moves the word behind the other; a form that is written as a firm and as a person is either
    assert groups(spark, ["NIDIDIRU NIDIGUBADIFO", "NIDGUBADIFO NIDIDIRU"]) == [[0, 1]]
    assert groups(spark, ["NIDIGUBADIFO NIDIDIRU LTD", "NIDIGUBADIFO NIDIDIRU", "NIDGUBADIFO NIDIDIRU"]) == [[0, 1, 2]]


def test_names_a_consonant_apart_that_are_each_written_in_several_ways_stay_apart(spark):
    ways = lambda v, w: [f"{v} {w} PVT LTD", f"UPI/1/{w} {v}/AXIS BANK", f"{v}{w}"[:14], f"{v} {w} INDIA", f"{v} {w[0]}"]
    assert groups(spark, ways("GUBAKEGURURU", "LALANINI") + ways("GULAKEGURURU", "LALANINI")) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9]]
    # a slip that stands alone joins one of them, and takes them no nearer to each other
    assert groups(spark, ["KERLETTA", "KERLETTA INDIA", "KERKETTA", "KERMETTA", "KERMETTA INDIA"]) == [[0, 1, 2], [3, 4]]
    assert groups(spark, ["KERLETTA", "KERKETTA", "KERMETTA"]) == [[0, 1, 2]]


def test_equal_letters_whose_words_end_elsewhere_are_two_names(spark):
    names = ["GUNILAGUDIME MEKERUPO LTD", "NEFT-GUNILAGUDIME MEKERUPO LTD", "GUNILAGUDIMEMEKERUPO", "UPI/1/GUNILAGU DIMEMEKERUPO/AXIS BANK", "DIMEMEKERUPO GUNILAGU"]
    of, e, _ = entities(spark, names)
    assert of == {0: "GUNILAGUDIMEMEKERUPO", 1: "GUNILAGUDIMEMEKERUPO", 2: "GUNILAGUDIMEMEKERUPO", 3: "DIMEMEKERUPOGUNILAGU", 4: "DIMEMEKERUPOGUNILAGU"} and len(e) == 2
    # where both would go by the same letters, the second one goes by its words; a decision is about the one that it names
    of, e, _ = entities(spark, names[:4])
    assert of[0] == of[1] == of[2] == "GUNILAGUDIMEMEKERUPO" and of[3] == "GUNILAGU DIMEMEKERUPO" and len(e) == 2
    assert groups(spark, [*names[:4], "ACME"], decisions=[("GUNILAGU DIMEMEKERUPO", "ACME", True)]) == [[0, 1, 2], [3, 4]]
    # the same words in another order are one name
    assert groups(spark, ["BABABABABABA BABABABA", "BABABABA BABABABABABA"]) == [[0, 1]]


def test_decisions_hold_for_every_spelling_and_are_never_crossed(spark):
    names = ["CHETHAN", "CHETAN", "ACME TRADERS", "ZENITH SUPPLIES PVT LTD", "CHETAAN"]
    d = [("NEFT-Chethan", "CHETAN", False), ("ACME TRADER", "ZENITH SUPPLY", True), ("CHETHAN", "CHETAN", True)]
    got = groups(spark, names, decisions=d)
    assert [2, 3] in got and not any(0 in g and 1 in g for g in got)
    assert groups(spark, ["CHETHAN", "CHETAN"]) == [[0, 1]]


def test_a_decision_takes_no_name_a_consonant_apart_with_it(spark):
    ways = lambda v, w: [f"{v} {w} PVT LTD", f"UPI/1/{w} {v}/AXIS BANK", f"{v}{w}"[:14]]
    names = ways("GUBAKEGURURU", "LALANINI") + ways("GULAKEGURURU", "LALANINI") + ["ZENITH SUPPLIES"]
    assert groups(spark, names, decisions=[("GUBAKEGURURU LALANINI", "ZENITH SUPPLY", True)]) == [[0, 1, 2, 6], [3, 4, 5]]


def test_identifiers_promote_and_veto(spark):
    assert groups(spark, ["QRS METALS", "QRX VENTURES"], ids={0: ["vpa:q@x"], 1: ["vpa:q@y"]}) == [[0], [1]]
    assert groups(spark, ["THRISHA ENTERPRISES", "TRISHA ENTERPRISE"], ids={0: ["account:9911"], 1: ["account:1199"]}) == [[0], [1]]
    assert groups(spark, ["THRISHA ENTERPRISES", "TRISHA ENTERPRISE"], ids={0: ["account:9911"], 1: ["account:9911"]}) == [[0, 1]]
    # one identifier for two names without a letter in common
    assert groups(spark, ["BLUEBELL", "OXFORD"], ids={0: ["vpa:q@x"], 1: ["vpa:q@x"]}) == [[0, 1]]


def test_a_branch_does_not_join_through_the_common_name_but_is_suggested(spark):
    of, e, s = entities(spark, ["SUNRISE STORE", "SUNRISE STORE 1", "SUNRISE STORE 2"])
    assert len(set(of.values())) == 3 and len(e) == 3
    assert {(r.a_entity, r.b_entity) for r in s} == {("SUNRISESTORE", "SUNRISESTORE1"), ("SUNRISESTORE", "SUNRISESTORE2")}


def test_branches_of_names_a_consonant_apart_are_suggested_for_their_own_name_only(spark):
    names = [f"{n}{b}" for n in ("FOKENIKEBARU FOMEBANI", "FOMENIKEBARU FOMEBANI") for b in (" LTD", " 1", " 2")]
    of, _, s = entities(spark, names)
    assert len(set(of.values())) == 6
    forms = ["FOKENIKEBARUFOMEBANI", "FOMENIKEBARUFOMEBANI"]
    assert {(r.a_entity, r.b_entity) for r in s} == {(f, f"{f}{b}") for f in forms for b in "12"}
    # each has the beginning of a word of the other
    assert groups(spark, ["BANIKEPOGUDI MEKEMEME 1", "MEKEMEMEMEME BANIKEPO 1"]) == [[0], [1]]


def test_empty_null_and_repeated_mentions(spark):
    of, e, s = entities(spark, [None, "", "UPI/12345678/", "ABC TRADERS", "ABC TRADERS", "AB"])
    assert of == {0: None, 1: None, 2: None, 3: "ABCTRADER", 4: "ABCTRADER", 5: "AB"}
    assert sorted((r.entity, r.forms, r.mentions) for r in e) == [("AB", 1, 1), ("ABCTRADER", 1, 2)] and s == []
    assert entities(spark, []) == ({}, [], [])


def one_by_one(n, links, walls):
    """Links by falling score, each taken unless a wall stands between the two clusters."""
    of = {i: {i} for i in n}
    for a, b, _ in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        x, y = of[a], of[b]
        if x is not y and not any((p, q) in walls or (q, p) in walls for p in x for q in y):
            x |= y
            for i in y:
                of[i] = x
    return {i: min(of[i]) for i in n}


@pytest.mark.parametrize("seed", range(4))
def test_clusters_are_those_of_links_taken_one_by_one(spark, seed):
    r = random.Random(seed)
    n = [f"n{i:02d}" for i in range(24)]
    pairs = [(a, b) for i, a in enumerate(n) for b in n[i + 1 :]]
    links = [(a, b, r.choice([860, 900, 950, 1000])) for a, b in r.sample(pairs, 30)]
    links += [("n00", x, 910) for x in n[1:9]]  # a name that many are linked with
    links = list({(a, b): (a, b, s) for a, b, s in links}.values())
    walls = set(r.sample(pairs, [0, 3, 30, 90][seed])) | ({("n01", "n02"), ("n03", "n04")} if seed else set())
    f = spark.createDataFrame([(x,) for x in n], "form string")
    w = spark.createDataFrame(sorted(walls), "a string, b string") if walls else None
    got = {x.form: x.entity for x in R.clusters(f, spark.createDataFrame(links, "a string, b string, score long"), w).collect()}
    assert got == one_by_one(n, links, walls)


def test_settled_names_never_join_one_cluster(spark):
    r = random.Random(9)
    n = [f"n{i:02d}" for i in range(20)]
    pairs = [(a, b) for i, a in enumerate(n) for b in n[i + 1 :]]
    links = [(a, b, r.choice([860, 920])) for a, b in r.sample(pairs, 40)]
    settled, walls = r.sample(n, 5), {("n00", "n01"), ("n02", "n05")}
    kept = walls | {(a, b) for a, b in pairs if a in settled and b in settled}
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = R.clusters(df([(x,) for x in n], "form string"), df(links, "a string, b string, score long"), df(sorted(walls), "a string, b string"), df([(x,) for x in settled], "form string"))
    assert {x.form: x.entity for x in got.collect()} == one_by_one(n, links, kept)


def test_forms_read_each_name_once(spark):
    """Names whose party is looked for again for each use of it made scores of many names slow."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def named(i):
        read.add(1)
        return f"ACME{chr(65 + i % 26)}{chr(65 + i // 26)} TRADERS PVT LTD"

    rows = spark.range(200).select("id", named("id").alias("name"))
    assert R.forms(R.mentions(rows, "id", "name")).count() == 200
    assert read.value == 200
