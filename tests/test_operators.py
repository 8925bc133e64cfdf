"""Small cases for operators, readers and streams that SQL does not cover."""

import datetime as dt
import io
import itertools
import os
import random
import subprocess
import sys
import zipfile

import pytest

from ledgerloom.functions import text
from ledgerloom.operators import entities, fx, matching
from ledgerloom.sources import detect, statements
from ledgerloom.streaming import metering
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_suggestions_take_the_best_pairs_first(spark):
    rng, day = random.Random(4), dt.date(2024, 1, 1)
    book = [(i, rng.randrange(2), "debit", rng.randrange(3), day + dt.timedelta(rng.randrange(60)), rng.choice(["ACME TOOLS", "BOLTS", None])) for i in range(60)]
    bank = [(i, rng.randrange(2), "debit", rng.randrange(3), day + dt.timedelta(rng.randrange(60)), rng.choice(["ACME", "BOLTS LTD", None])) for i in range(60)]
    b = spark.createDataFrame(book, "book_id long, account_id long, direction string, amount_paise long, entry_date date, party_name string")
    t = spark.createDataFrame(bank, "txn_id long, account_id long, direction string, amount_paise long, txn_date date, counterparty string")
    tie = {(r.b, r.t): r.h for r in spark.range(60).selectExpr("id as b").crossJoin(spark.range(60).selectExpr("id as t")).select("b", "t", F.xxhash64("b", "t").alias("h")).collect()}
    named = lambda c: {w for w in (c or "").split() if len(w) >= 4}
    pairs = [(-len(named(x[5]) & named(y[5])), abs((x[4] - y[4]).days), tie[x[0], y[0]], x[0], y[0]) for x in book for y in bank if y[1:4] == x[1:4] and abs((x[4] - y[4]).days) <= 30]
    used_b, used_t, want = set(), set(), set()
    for common, gap, _, x, y in sorted(pairs):
        if (common < 0 or gap <= 7) and x not in used_b and y not in used_t:
            used_b.add(x)
            used_t.add(y)
            want.add((x, y))
    assert {tuple(r) for r in matching.suggestions(b, t).collect()} == want


def test_a_crowd_of_suggestions_makes_no_pairs_of_rows(spark, monkeypatch):
    """3,000 equal entries and 2,500 equal bank rows, two of them rejected: as many pairs of each gap and of words in common as a choice row by row makes, from few pairs of classes."""
    from ledgerloom.operators.matching import stored

    sizes = {}
    monkeypatch.setattr(matching, "stored", lambda df, name: (out := stored(df, name), sizes.setdefault(name, out.count()))[0])
    day = "date_add(date'2024-01-01', cast(id % {} as int))"
    b = spark.range(3000).selectExpr("id as book_id", "1L as account_id", "'debit' as direction", "5L as amount_paise", f"{day.format(3)} as entry_date", "case when id % 2 = 0 then 'ACME TOOLS' else 'BOLT' || id % 4 end as party_name")
    t = spark.range(2500).selectExpr("id as txn_id", "1L as account_id", "'debit' as direction", "5L as amount_paise", f"{day.format(5)} as txn_date", "case when id % 2 = 0 then 'ACME' else 'NUTS' end as counterparty")
    no = spark.createDataFrame([(0, 0), (3, 0)], "book_id long, txn_id long")
    got = matching.suggestions(b, t, rejected=no)
    assert sizes["class-pairs"] < 200
    pairs = got.join(b, "book_id").join(t, "txn_id").toPandas()
    assert len(pairs) == 2500 and pairs.book_id.is_unique and pairs.txn_id.is_unique and not ((pairs.txn_id == 0) & pairs.book_id.isin([0, 3])).any()
    named = pairs[pairs.party_name == "ACME TOOLS"]
    assert (named.counterparty == "ACME").sum() == 1250  # all that have a word in common
    assert sum(a == b for a, b in zip(named.entry_date, named.txn_date)) >= 750 - 1  # of equal words the nearest day first


def test_a_crowd_of_targets_looks_for_its_rows_once(spark, monkeypatch):
    """2,000 equal targets beside 500 smaller rows, and one of another sum: the rows near are numbered once for each sum."""
    from ledgerloom.operators.matching import day_band

    met = []
    monkeypatch.setattr(matching, "day_band", lambda *a: (out := day_band(*a), met.append(out.count()))[0])
    t = spark.range(2001).selectExpr("id as txn_id", "1L as account_id", "'debit' as direction", "if(id = 2000, 1001L, 1000L) as amount_paise", "date'2024-01-01' as txn_date")
    b = spark.range(500).selectExpr("id as book_id", "1L as account_id", "'debit' as direction", "if(id < 2, 500L, 300L) as amount_paise", "date'2024-01-02' as entry_date")
    assert {tuple(r) for r in matching.group_matches(t, "txn_id", "txn_date", b, "book_id", "entry_date").collect()} == {(0, 0), (0, 1)}
    assert met[0] == 2 * 500


def test_group_matches(spark):
    day = lambda n: dt.date(2024, 5, 1) + dt.timedelta(n)
    bank = spark.createDataFrame([(1, 1, "debit", 100, day(3)), (2, 1, "debit", 60, day(3)), (3, 1, "credit", 30, day(0)), (4, 2, "debit", 100, day(0)), (5, 1, "debit", 77, day(0))], "txn_id long, account_id long, direction string, amount_paise long, txn_date date")
    book = spark.createDataFrame([(11, 1, "debit", 40, day(3)), (12, 1, "debit", 60, day(4)), (13, 1, "debit", 20, day(3)), (14, 1, "credit", 10, day(0)), (15, 1, "credit", 20, day(9)), (16, 2, "debit", 50, day(1)), (17, 2, "debit", 30, day(1)), (18, 2, "debit", 20, day(1)), (19, 1, "debit", 76, day(0))], "book_id long, account_id long, direction string, amount_paise long, entry_date date")
    got = {tuple(r) for r in matching.group_matches(bank, "txn_id", "txn_date", book, "book_id", "entry_date").collect()}
    assert got == {(1, 11), (1, 12), (4, 16), (4, 17), (4, 18)}
    assert matching.parts_of(10, [(i, 1) for i in range(30)]) is None and matching.parts_of(5, [(1, 9), (2, 2), (3, 3)]) == [2, 3]


def test_crowds_of_groups_lose_no_match(spark):
    """60 equal targets and 60 of other sums in one week: each takes its own group, whatever the rounds."""
    day = dt.date(2024, 5, 1)
    bank = [(i, 1, "debit", 1000, day) for i in range(60)] + [(100 + i, 2, "debit", 5000 + i, day) for i in range(60)]
    book = [(1000 + 2 * i + k, 1, "debit", (400, 600)[k], day) for i in range(60) for k in (0, 1)] + [(2000 + 2 * i + k, 2, "debit", (2000, 3000 + i)[k], day) for i in range(60) for k in (0, 1)]
    t = spark.createDataFrame(bank, "txn_id long, account_id long, direction string, amount_paise long, txn_date date")
    b = spark.createDataFrame(book, "book_id long, account_id long, direction string, amount_paise long, entry_date date")
    got = matching.group_matches(t, "txn_id", "txn_date", b, "book_id", "entry_date").toPandas()
    amounts, whole = {x[0]: x[3] for x in book}, {x[0]: x[3] for x in bank}
    assert got.book_id.is_unique and all(sum(amounts[p] for p in g.book_id) == whole[k] for k, g in got.groupby("txn_id"))
    assert sum(k < 100 for k in got.txn_id.unique()) == 60 and set(range(100, 115)) == {int(k) for k in got.txn_id.unique() if k >= 100}  # the others see none of their parts among the 30 nearest
    with pytest.raises(RuntimeError, match="settle"):
        matching.group_matches(t, "txn_id", "txn_date", b, "book_id", "entry_date", most_rounds=1)


def test_mutual_best_is_the_greedy_choice(spark):
    rng = random.Random(4)
    for _ in range(4):
        pairs = {(rng.randrange(12), rng.randrange(12)): rng.randrange(4) for _ in range(50)}
        df = spark.createDataFrame([(a, b, g) for (a, b), g in pairs.items()], "l long, r long, gap long").withColumn("h", F.xxhash64("l", "r"))
        rows = sorted(df.collect(), key=lambda x: (x.gap, x.h))
        want, ls, rs = set(), set(), set()
        for x in rows:
            if x.l not in ls and x.r not in rs:
                want.add((x.l, x.r)), ls.add(x.l), rs.add(x.r)
        assert {tuple(x) for x in matching.mutual_best(df, "l", "r", ["gap"], ["gap"]).select("l", "r").collect()} == want


def test_rejected_pairs_make_way_within_their_pass(spark):
    day = dt.date(2024, 5, 1)
    book = spark.createDataFrame([(1, 1, "debit", 100, day, None, None), (2, 1, "debit", 200, day, "REF 1234567", None)], "book_id long, account_id long, direction string, amount_paise long, entry_date date, instrument_no string, party_name string")
    bank = spark.createDataFrame([(1, 1, "debit", 100, day, None, None, None), (2, 1, "debit", 100, day, None, None, None), (3, 1, "debit", 200, day + dt.timedelta(40), None, "NEFT REF1234567 X 01052024", None)], "txn_id long, account_id long, direction string, amount_paise long, txn_date date, reference_no string, narration string, counterparty string")
    no = spark.createDataFrame([(1, 1)], "book_id long, txn_id long")
    assert {tuple(r) for r in matching.reconcile(book, bank, no).collect()} == {(1, 2, "same_day"), (2, 3, "shared_id")}


def test_python_workers_find_the_package_from_anywhere(tmp_path):
    """A session that was started in another folder, without the repository on the workers' path."""
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from ledgerloom.operators import matching, similarity
df = spark.createDataFrame([("MARTHA", "MARHTA")], "a string, b string")
assert round(df.select(similarity.jaro_winkler("a", "b")).first()[0], 3) == 0.961
t = spark.sql("select 1L as txn_id, 1L as account_id, 'debit' as direction, 10L as amount_paise, date'2024-01-01' as txn_date")
b = spark.sql("select id as book_id, 1L as account_id, 'debit' as direction, 5L as amount_paise, date'2024-01-01' as entry_date from range(2)")
assert matching.group_matches(t, "txn_id", "txn_date", b, "book_id", "entry_date").count() == 2
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_CONF_DIR")}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]


def test_parts_of_is_the_first_combination():
    rng = random.Random(6)
    for _ in range(300):
        pool = [(i, rng.randrange(1, 400)) for i in range(rng.randrange(0, 14))]
        target = rng.randrange(2, 900)
        want = next((list(c) for k in range(2, 6) for c in itertools.combinations([i for i, _ in pool], k) if sum(dict(pool)[i] for i in c) == target), None)
        assert matching.parts_of(target, pool) == want


def test_rejected_pairs_never_match_again(spark):
    day = dt.date(2024, 5, 1)
    book = spark.createDataFrame([(1, 1, "debit", 100, day, "R-1", None), (2, 1, "debit", 9, day, None, None)], "book_id long, account_id long, direction string, amount_paise long, entry_date date, instrument_no string, party_name string")
    bank = spark.createDataFrame([(11, 1, "debit", 100, day, "r1x", None), (12, 1, "debit", 9, day, None, None)], "txn_id long, account_id long, direction string, amount_paise long, txn_date date, reference_no string, counterparty string")
    no = spark.createDataFrame([(2, 12)], "book_id long, txn_id long")
    assert {tuple(r)[:2] for r in matching.reconcile(book, bank, no).collect()} == {(1, 11)}


def test_transfers_are_one_to_one_and_need_evidence(spark):
    day = lambda n: dt.date(2024, 5, 1) + dt.timedelta(n)
    rows = [
        (1, 1, "debit", 500, day(0), "UTR 123456789012"), (2, 1, "debit", 500, day(1), "UTR 123456789012"), (3, 2, "credit", 500, day(1), "IN 123456789012"),
        (4, 1, "debit", 70, day(0), "TO XX0002 Y"), (5, 2, "credit", 70, day(2), "IN"), (6, 1, "debit", 71, day(0), "shop"), (7, 2, "credit", 71, day(0), "shop"),
        (8, 2, "debit", 90, day(0), "paid RED SQUARE infra"), (9, 1, "credit", 90, day(0), "in"), (10, 2, "debit", 91, day(1), "paid RED SQUARE infra"), (11, 1, "credit", 91, day(0), "in"),
    ]
    txn = spark.createDataFrame(rows, "txn_id long, account_id long, direction string, amount_paise long, txn_date date, narration string")
    accounts = spark.createDataFrame([(1, "9000000001", "Red Square Pvt Ltd"), (2, "9000000002", None)], "account_id long, number string, holder string")
    got = {tuple(r) for r in matching.transfers(txn, accounts).collect()}
    assert got == {(1, 3, "shared reference"), (4, 5, "account number"), (8, 9, "holder name")}


def test_rates_keep_every_row(spark):
    quotes = spark.createDataFrame([("USD", dt.date(2000, 1, 10), "80"), ("USD", dt.date(2000, 3, 5), "81"), ("EUR", dt.date(2000, 1, 1), "90")], "code string, as_of date, x string").selectExpr("code", "as_of", "cast(x as decimal(20,8)) as inr_per_unit")
    days = [dt.date(1985, 1, 1), dt.date(2000, 1, 9), dt.date(2000, 1, 10), dt.date(2000, 3, 4), dt.date(2000, 3, 5), dt.date(2040, 1, 1), None]
    txn = spark.createDataFrame(list(enumerate(days)), "txn_id long, txn_date date").withColumn("amount_paise", F.lit(8000).cast("long"))
    got = {r.txn_id: (float(r.inr_per_unit), r.converted) for r in fx.convert(txn, quotes, "USD").collect()}
    assert [got[i][0] for i in range(7)] == [80, 80, 80, 80, 81, 81, 81] and got[0][1] == 100
    assert {r.inr_per_unit for r in fx.with_rate(txn, quotes, "GBP").collect()} == {None} and fx.with_rate(txn, quotes, "GBP").count() == 7


def test_reconcile_is_one_to_one(spark):
    day = dt.date(2024, 5, 1)
    book = spark.createDataFrame([(1, 1, "debit", 100, day), (2, 1, "debit", 100, day), (3, 1, "debit", 7, day), (4, 2, "credit", 9, day)], "book_id long, account_id long, direction string, amount_paise long, entry_date date")
    bank = spark.createDataFrame([(11, 1, "debit", 100, day), (12, 1, "debit", 100, day + dt.timedelta(2)), (13, 1, "debit", 7, day + dt.timedelta(20))], "txn_id long, account_id long, direction string, amount_paise long, txn_date date")
    book, bank = book.selectExpr("*", "cast(null as string) as instrument_no", "if(book_id = 3, 'BLUE HARBOUR', null) as party_name"), bank.selectExpr("*", "cast(null as string) as reference_no", "'BLUE HARBOUR' as counterparty")
    got = matching.reconcile(book, bank)
    assert {tuple(r) for r in got.collect()} == {(1, 11, "same_day"), (2, 12, "only_candidate"), (3, 13, "suggestion")}
    left = {(r.account_id, r.side, r.n, r.amount_paise) for r in matching.bridge(book, bank, got).collect()}
    assert left == {(2, "book", 1, 9)}


def test_reconcile_by_shared_id(spark):
    day = lambda n: dt.date(2024, 5, 1) + dt.timedelta(n)
    book = [(4, 1, "debit", 55, day(0), "CHQ-0042"), (5, 1, "debit", 55, day(60), None), (6, 1, "debit", 56, day(0), "NONE"), (7, 1, "debit", 57, day(0), "ABC1"), (8, 1, "debit", 57, day(1), "ABC1")]
    bank = [(14, 1, "debit", 55, day(60), "chq0042"), (15, 1, "debit", 56, day(80), "NONE"), (16, 1, "debit", 57, day(1), "ABC1"), (17, 1, "debit", 57, day(91), "ABC1")]
    b = spark.createDataFrame(book, "book_id long, account_id long, direction string, amount_paise long, entry_date date, instrument_no string").withColumn("party_name", F.lit(None).cast("string"))
    t = spark.createDataFrame(bank, "txn_id long, account_id long, direction string, amount_paise long, txn_date date, reference_no string").withColumn("counterparty", F.lit(None).cast("string"))
    got = {tuple(r) for r in matching.reconcile(b, t).collect() if r.method == "shared_id"}
    assert got == {(4, 14, "shared_id"), (7, 16, "shared_id"), (8, 17, "shared_id")}


def test_clusters_follow_long_chains(spark):
    names = spark.range(40).select("id", F.lit("x").alias("name"))
    chain = spark.range(39).select(F.col("id").alias("a_id"), (F.col("id") + 1).alias("b_id"), F.lit(900).alias("ratio"))
    assert {r.cluster for r in entities.clusters(names, chain).collect()} == {0}


def test_crowded_blocks_keep_pairs_of_different_skeletons(spark):
    rng = random.Random(5)
    names = [(i, "Party " + "".join(rng.choice("abkt") for _ in range(5))) for i in range(80)]
    df = spark.createDataFrame(names, "id long, name string")
    want = {tuple(r) for r in entities.pairs(df, most=1000).collect()}
    assert len(want) == 80 * 79 // 2 == len({r[:2] for r in want})
    assert {tuple(r) for r in entities.pairs(df, most=7).collect()} == want
    root = {i: i for i, _ in names}
    for _ in names:
        for a, b, ratio in want:
            if ratio >= 860:
                root[a] = root[b] = min(root[a], root[b])
    assert {tuple(r) for r in entities.clusters(df, entities.pairs(df, most=7, least=860)).collect()} == set(root.items())


def test_crowds_of_equal_amounts_make_no_pairs(spark):
    """Only candidates, transfers and bare duplicates of a crowd against all pairs."""
    rng, day = random.Random(2), lambda n: dt.date(2024, 5, 1) + dt.timedelta(n)
    book = [(i, 1, "debit", rng.choice([5, 6, 7, 8, 9]) * rng.choice([1, 1, 100 + i]), day(rng.randrange(60))) for i in range(60)]
    bank = [(1000 + i, *b[1:4], b[4] + dt.timedelta(rng.randrange(-9, 10))) for i, b in enumerate(book)]
    barred = [(b[0], t[0]) for b in book for t in bank if rng.random() < 0.1]
    b, t = spark.createDataFrame(book, "book_id long, account_id long, direction string, amount_paise long, entry_date date"), spark.createDataFrame(bank, "txn_id long, account_id long, direction string, amount_paise long, txn_date date")
    for no in ([], barred):
        pairs = [(x[0], y[0]) for x in book for y in bank if x[3] == y[3] and abs((x[4] - y[4]).days) <= 7 and (x[0], y[0]) not in no]
        want = {p for p in pairs if sum(q[0] == p[0] for q in pairs) == 1 == sum(q[1] == p[1] for q in pairs)}
        got = matching.only_candidates(b, t, rejected=spark.createDataFrame(no, "book_id long, txn_id long") if no else None)
        assert {tuple(r) for r in got.collect()} == want and want
    led = [(i, 1 + i % 2, "debit" if i % 3 else "credit", 5, day(0), "TO XX0009" if i % 5 else "BY 12345678901", f"R{i % 4}", i % 6 or None, None) for i in range(30)]
    l = spark.createDataFrame(led, "txn_id long, account_id long, direction string, amount_paise long, txn_date date, narration string, reference_no string, balance_paise long, statement_id long")  # noqa: E741
    same = lambda x, y: x[0] < y[0] and x[1:3] == y[1:3] and x[6] != y[6] and (x[7] is None or y[7] is None or x[7] == y[7])
    two = matching.tier_two(l)
    assert sorted((r.a_id, r.b_id) for r in two.collect()) == sorted((x[0], y[0]) for x in led for y in led if same(x, y))
    moved = matching.transfers(l, spark.createDataFrame([(1, "7770000001", None), (2, "7770000009", None)], "account_id long, number string, holder string")).collect()
    assert {r.evidence for r in moved} == {"account number", "shared reference"} and len({r.debit_id for r in moved}) == len({r.credit_id for r in moved}) == len(moved)


def test_name_clusters_without_all_pairs(spark):
    rng = random.Random(5)
    names = []
    for i in range(120):
        b = list(rng.choice(["ACME TRADERS 12", "ACME TRADING CO", "RAMESHKUMARI", "ZENITH SUPPLIES INDIA", "SHORT"]))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(b))
            b[at : at + rng.randrange(2)] = rng.choice(["A", "X", " ", ""])
        names.append((i, "".join(b)))
    df = spark.createDataFrame([*names, (120, ""), (121, None), (122, ""), (123, "SHORT")], "id long, name string")
    want = {tuple(r) for r in entities.clusters(df, entities.pairs(df, least=860)).collect()}
    assert {tuple(r) for r in entities.clusters_of_names(df, most=20).collect()} == want


def test_names_with_a_letter_left_out_are_never_broadcast(spark, monkeypatch):
    """They are many times as many as the names, which Spark doesn't know: broadcasting them broke the driver at 90,000 names."""
    plans = []

    def stored(df, name, f=entities.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return f(df, name)

    monkeypatch.setattr(entities, "stored", stored)
    df = spark.createDataFrame([(i, f"Party Customer {i}") for i in range(40)] + [(40, "Party Custmer 7"), (41, "Party Of Others")], "id long, name string")
    got = {r.id: r.cluster for r in entities.clusters_of_names(df).collect()}
    assert {got[i] for i in range(41)} == {0} and got[41] == 41
    multiplied = [p for p in plans if "Generate" in p]
    assert multiplied and not [p for p in multiplied if "BroadcastHashJoin" in p]


@pytest.mark.parametrize(("cell", "paise"), [("1,23,456.50", 12345650), ("₹ 99.9 Cr", 9990), ("(12.00)", 1200), ("0.00", None), ("abc", None), (None, None)])
def test_amount(spark, cell, paise):
    assert spark.createDataFrame([(cell,)], "c string").select(text.amount(F.col("c"))).first()[0] == paise


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Some Bank\nDate,Narration,Debit,Credit,Balance\n01/02/2024,rent,\"1,000.00\",,500.00\n02/02/2024,pay,,20.50,520.50\nx,bad,,,\n")
    rows = sorted(statements.read_statement(spark, str(tmp_path / "a.csv")).collect(), key=lambda r: r.n)
    assert [(str(r.txn_date), r.direction, r.amount_paise, r.balance_paise) for r in rows[-3:-1]] == [("2024-02-01", "debit", 100000, 50000), ("2024-02-02", "credit", 2050, 52050)]
    assert set(rows[-1].warnings) == {"date_unreadable", "no_amount", "no_direction"}
    (tmp_path / "b.json").write_text('{"transactions": [{"date": "2024-03-01", "narration": "tea", "amount": "-5"}]}')
    r = statements.read_statement(spark, str(tmp_path / "b.json")).first()
    assert (str(r.txn_date), r.direction, r.amount_paise) == ("2024-03-01", "debit", 500)
    (tmp_path / "c.ofx").write_text("<BANKTRANLIST><STMTTRN><DTPOSTED>20240401<TRNAMT>-7.25<NAME>shop<STMTTRN><DTPOSTED>20240402<TRNAMT>3<NAME>gift</BANKTRANLIST>")
    got = statements.read_statement(spark, str(tmp_path / "c.ofx")).orderBy("n").collect()
    assert [(str(r.txn_date), r.direction, r.amount_paise, r.narration) for r in got] == [("2024-04-01", "debit", 725, "shop"), ("2024-04-02", "credit", 300, "gift")]


def test_delimited_encodings_and_ragged_lines(spark, tmp_path):
    lines = "Date;Narration;Amount\n01/02/2024;caf\u00e9;-5.00\n"
    (tmp_path / "w.csv").write_bytes(lines.encode("cp1252"))
    (tmp_path / "u.csv").write_bytes(lines.encode("utf-16"))
    for name in ("w.csv", "u.csv"):
        r = statements.read_statement(spark, str(tmp_path / name), "csv").collect()
        assert [(x.narration, x.direction, x.amount_paise) for x in r] == [("caf\u00e9", "debit", 500)]
    rows = ["Date,Narration,Amount"] + ["01/02/2024,a,1"] * 150 + ["02/02/2024,b,2,x,y,z"]
    (tmp_path / "r.csv").write_text("\n".join(rows))
    assert statements.read_delimited(spark, str(tmp_path / "r.csv")).count() == 151
    (tmp_path / "none.csv").write_text("a,b,c\n1,2,3\n")
    with pytest.raises(ValueError, match="no header"):
        statements.read_delimited(spark, str(tmp_path / "none.csv"))


def test_each_file_by_its_own_header_separator_and_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date,Narration,Debit,Credit\n01/02/2024,rent,50.00,\n,of flat 7,,\n,second line,,\n,total,50.00,\n02/02/2024,pay,,10.00\n")
    (tmp_path / "b.csv").write_text("Some Bank\nDate,Narration,Credit,Debit,Balance\n03/02/2024,fee,,50.00,1.00\n")
    (tmp_path / "c.csv").write_bytes("Date;Narration;Amount\n04/02/2024;CAFÉ €;-7.00\n".encode("cp1252"))
    (tmp_path / "d.csv").write_bytes("Date;Narration;Amount\n05/02/2024;CAFÉ €;8.00 Cr\n".encode())
    (tmp_path / "e.csv").write_bytes("Date\tNarration\tAmount\n06/02/2024\tCAFÉ €\t-9.00\n".encode("utf-16"))
    (tmp_path / "f.csv").write_text("one,two,three\n1,2,3\n")
    got = statements.typed(statements.read_delimited(spark, str(tmp_path))).collect()
    rows = sorted((r.txn_date.day, r.narration, r.direction, r.amount_paise, r.file[-5:]) for r in got if r.txn_date)
    assert rows == [
        (1, "rent of flat 7 second line", "debit", 5000, "a.csv"), (2, "pay", "credit", 1000, "a.csv"), (3, "fee", "debit", 5000, "b.csv"),
        (4, "CAFÉ €", "debit", 700, "c.csv"), (5, "CAFÉ €", "credit", 800, "d.csv"), (6, "CAFÉ €", "debit", 900, "e.csv"),
    ]
    assert [(r.file[-5:], r.warnings[0]) for r in got if not r.txn_date] == [("f.csv", "no_header")]


def test_continuation_lines_over_block_borders(spark, tmp_path):
    """Files split into small blocks: a line continues the row before it, wherever the block ends, and n keeps the order."""
    lines = ["Date,Narration,Debit,Credit"] + [x for i in range(200) for x in (f"{i % 28 + 1:02d}/03/2024,row {i},{i + 1}.00,", f",more {i},,")]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        rows = statements.read_delimited(spark, str(tmp_path / "a.csv")).orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r.narration for r in rows] == [f"row {i} more {i}" for i in range(200)]


def test_delimited_files_are_read_once(spark, tmp_path):
    """The result's plan has no scan of the files, which were read once to lines; a line of blank cells is no line, in the header's place either."""
    (tmp_path / "a.tsv").write_text("\t\t\nDate\tNarration\tAmount\n01/02/2024\tfirst\t-7.00\n\t\t\n02/02/2024\tnext\t8.00\n\tof more\t\n")
    rows = statements.read_delimited(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "FileScan csv" not in plan and "FileScan text" not in plan
    assert [(r.date, r.narration, r.debit, r.credit, r.amount) for r in rows.orderBy("n").collect()] == [("01/02/2024", "first", None, None, "-7.00"), ("02/02/2024", "next of more", None, "8.00", "8.00")]


def test_json_signs_are_decided_by_document(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"date": "2024-03-01", "amount": "-5"}, {"date": "2024-03-02", "amount": "7"}]')
    (tmp_path / "b.json").write_text('[{"date": "2024-03-03", "amount": "9"}]')
    got = {str(r.txn_date): r.direction for r in statements.read_statement(spark, str(tmp_path)).collect()}
    assert got == {"2024-03-01": "debit", "2024-03-02": "credit", "2024-03-03": None}


def test_statement_headers(spark, tmp_path):
    (tmp_path / "a.ofx").write_text("<OFX><STMTRS><CURDEF>INR<BANKID>B1<ACCTID>123<LEDGERBAL><BALAMT>-12.50<DTASOF>20240430</LEDGERBAL></STMTRS>"
                                    "<CCSTMTRS><CURDEF>USD<ACCTID>9<LEDGERBAL><BALAMT>x</LEDGERBAL></CCSTMTRS></OFX>")  # fmt: skip
    got = statements.ofx_accounts(spark, str(tmp_path / "a.ofx")).orderBy("account").collect()
    assert [(r.bank, r.account, r.currency, r.balance_paise, str(r.balance_date)) for r in got] == [("B1", "123", "INR", -1250, "2024-04-30"), (None, "9", "USD", None, "None")]
    bal = "<Bal><Tp><CdOrPrtry><Cd>{}</Cd></CdOrPrtry></Tp><Amt Ccy='EUR'>{}</Amt><CdtDbtInd>{}</CdtDbtInd></Bal>"
    (tmp_path / "b.xml").write_text("<Document><BkToCstmrStmt><Stmt><Acct><Id><IBAN>DE123456</IBAN></Id><Ccy>eur</Ccy></Acct><FrToDt><FrDt>2024-01-01</FrDt><ToDt>2024-01-31</ToDt></FrToDt>"
                                    + bal.format("OPBD", "10.00", "DBIT") + bal.format("CLBD", "2.5", "CRDT") + "</Stmt></BkToCstmrStmt></Document>")
    r = statements.camt_statements(spark, str(tmp_path / "b.xml")).first()
    assert (r.account, r.currency, str(r.period_start), str(r.period_end), r.opening_paise, r.closing_paise) == ("****3456", "EUR", "2024-01-01", "2024-01-31", -1000, 250)


def test_kinds_by_bytes_and_archives(spark, tmp_path):
    def packed(names):
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name in names:
                z.writestr(name, "x" * 50)
        return held.getvalue()

    files = {"a.csv": b"%PDF-1.4", "b.txt": b"a,b,c\n1,2,3\n", "c.tsv": b"a\tb\tc\n1\t2\t3", "d.dat": b"[1]", "e.qfx": b"<OFX>", "f.xml": b"<Document xmlns='urn:camt.053.001'/>", "g.xml": b"<html/>",
             "h.zip": packed(["xl/workbook.xml"]), "i.zip": packed(["d/s.csv", "__MACOSX/t.csv", "note.doc"]), "j.png": b"\x89PNG\r\n", "k.txt": b"plain words", "l.csv": b""}
    (tmp_path / "kinds").mkdir()
    for name, data in files.items():
        (tmp_path / "kinds" / name).write_bytes(data)
    got = {r.file.rsplit("/", 1)[1]: (r.format, r.mismatch) for r in detect.detect(spark, str(tmp_path / "kinds")).collect()}
    assert got == {"a.csv": ("pdf", True), "b.txt": ("csv", False), "c.tsv": ("tsv", False), "d.dat": ("json", False), "e.qfx": ("qfx", False), "f.xml": ("camt", False), "g.xml": ("unknown", False),
                   "h.zip": ("xlsx", True), "i.zip": ("zip", False), "j.png": ("unknown", False), "k.txt": ("txt", False)}
    assert {r.format for r in detect.detect(spark, str(tmp_path / "kinds" / "b.txt"), most_bytes=3).collect()} == {"too_long"}
    archives = str(tmp_path / "kinds" / "[ib].*")
    assert {(r.archive[-5:], r.member, bytes(r.content or b""), r.problem) for r in detect.expand_zip(spark, archives).collect()} == {
        ("i.zip", "d/s.csv", b"x" * 50, None), ("b.txt", None, b"", "not a readable archive")}
    assert {r.problem for r in detect.expand_zip(spark, archives, most_member_bytes=10).collect()} == {"too long", "not a readable archive"}


def test_upsert_keeps_status(spark):
    old = spark.createDataFrame([(1, "a", "done"), (2, "b", "open")], "id long, v string, status string")
    new = spark.createDataFrame([(1, "z", "open"), (3, "c", "open")], "id long, v string, status string")
    assert {tuple(r) for r in statements.upsert(old, new, "id").collect()} == {(1, "z", "done"), (2, "b", "open"), (3, "c", "open")}


def test_stream_equals_table(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, h, 10 * k), "ab"[k % 2], float(k)) for h in range(4) for k in range(6)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = metering.tumbling_usage(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("usage").collect()} == {tuple(r) for r in metering.tumbling_usage(table).collect()}
