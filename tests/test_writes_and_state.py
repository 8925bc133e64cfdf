"""Overlaps by brute force, repeated writes, and streams in two orders with a restart."""

import datetime as dt
import random

from ledgerloom.operators import blockers
from ledgerloom.sources import ledger_store
from ledgerloom.streaming import stateful

DAY = dt.date(2024, 1, 1)


def test_overlaps_by_brute_force(spark):
    rng = random.Random(3)
    span = lambda: (lambda a, n: (DAY + dt.timedelta(a), DAY + dt.timedelta(a + n)))(rng.randrange(300), rng.choice([0, 1, 5, 40, 200, -3]))
    a = [(i, rng.randrange(3), *span()) for i in range(60)] + [(99, 1, DAY, None)]
    b = [(i, rng.randrange(3), *span()) for i in range(60)]
    x = spark.createDataFrame(a, "x long, k long, a_from date, a_to date")
    y = spark.createDataFrame(b, "y long, k long, b_from date, b_to date")
    want = sorted((i, j) for i, k, f, u in a for j, m, g, v in b if k == m and u and f <= u and g <= v and f <= v and g <= u)
    out = blockers.overlaps(x, y, "k")
    assert sorted(tuple(r) for r in out.select("x", "y").collect()) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_statements_are_replaced_and_emptied(spark, tmp_path):
    path = str(tmp_path / "ledger")
    rows = lambda *r: spark.createDataFrame([*r], "statement_id long, txn_id long, narration string")
    ledger_store.replace_statements(rows((1, 1, "a"), (1, 2, "b"), (2, 3, "c"), (3, 4, "d")), path, buckets=2)
    for _ in range(2):
        ledger_store.replace_statements(rows((2, 9, "z")), path, spark.createDataFrame([(3,)], "statement_id long"), buckets=2)
        assert {tuple(r) for r in ledger_store.read_ledger(spark, path).select("statement_id", "txn_id", "narration").collect()} == {(1, 1, "a"), (1, 2, "b"), (2, 9, "z")}
    for s in (1, 2):
        ledger_store.replace_statements(rows().limit(0), path, spark.createDataFrame([(s,)], "statement_id long"), buckets=2)
    assert ledger_store.read_ledger(spark, path).count() == 0 if list((tmp_path / "ledger").glob("bucket=*")) else True


def test_match_lines_name_each_row_once(spark):
    m = spark.createDataFrame([(1, 10, "same_day"), (2, 11, "one_bank_row"), (3, 11, "one_bank_row"), (4, 12, "one_entry"), (4, 13, "one_entry")], "book_id long, txn_id long, method string")
    got = {(r.group_id, r.side, r.row_id) for r in ledger_store.match_lines(m, "r").collect()}
    assert got == {("b1", "book", 1), ("b1", "bank", 10), ("t11", "book", 2), ("t11", "book", 3), ("t11", "bank", 11), ("b4", "book", 4), ("b4", "bank", 12), ("b4", "bank", 13)}


ROWS = "account_id long, direction string, amount_paise long, reference_no string, ts timestamp, source_type string, row_index long, txn_id long"


def through(spark, tmp_path, name, files, schema, op):
    """The rows that a stream gives when files come one by one, with a restart of the query between them."""
    folder = tmp_path / name
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        df = op(spark.readStream.schema(schema).parquet(str(folder / "in")))
        df.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "state")).trigger(availableNow=True).start().awaitTermination(120)
    return spark.read.schema(df.schema).parquet(str(folder / "out")).collect()


def test_better_rows_replace_earlier_ones_in_any_order(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 5, 1, h)
    rows = [(1, "debit", 5, "R1", at(1), "email_alert", 0, 90), (1, "debit", 5, "R1", at(3), "statement", 7, 91), (1, "debit", 5, "R1", at(2), "statement", 4, 92), (1, "credit", 5, "R1", at(2), "email_alert", 0, 93), (2, "debit", 5, None, at(2), "email_alert", 1, 94), (2, "debit", 5, None, at(2), "email_alert", 1, 89)]
    want = {(1, "debit", 92), (1, "credit", 93), (2, "debit", 89)}
    for name, order in (("a", rows), ("b", rows[::-1])):
        got = through(spark, tmp_path, name, [order[:2], order[2:4], order[4:]], ROWS, stateful.survivors)
        last = {}
        for r in sorted(got, key=lambda r: r.version):
            last[r.account_id, r.direction, r.amount_paise] = r.txn_id
        assert {(a, d, i) for (a, d, _), i in last.items()} == want
        assert all(r.replaced is None for r in got if r.version == 1)


def test_requests_are_answered_once(spark, tmp_path):
    at = lambda h: dt.datetime(2024, 5, 1, h)
    schema = "client string, key string, fingerprint string, ts timestamp, request_id long"
    files = [[("c", "k", "f1", at(1), 1), ("c", "k", "f1", at(2), 2), ("d", "k", "f1", at(1), 3)], [("c", "k", "f2", at(3), 4), ("c", "k", "f1", at(4), 5), ("d", "j", "f9", at(4), 6)]]
    got = {r.request_id: (r.outcome, r.first_id) for r in through(spark, tmp_path, "r", files, schema, stateful.answered_once)}
    assert got == {1: ("new", 1), 2: ("replay", 1), 3: ("new", 3), 4: ("conflict", 1), 5: ("replay", 1), 6: ("new", 6)}


def test_canonical_rows_are_not_joined_with_themselves(spark, capsys):
    rows = spark.createDataFrame([(i, 1, 1, "2024-01-01", "debit", 5, "R", "UPI/DR/1/SHOP") for i in (1, 2, 2)], "txn_id long, statement_id long, account_id long, txn_date string, direction string, amount_paise long, reference_no string, narration string")
    got = ledger_store.canonical(rows, "a")
    assert got.count() == 3
    got.explain()
    assert "Join" not in capsys.readouterr().out
