"""Merging of statements, their order, printed openings and vetted quotes against plain Python."""

import datetime as dt
import heapq
import random

from ledgerloom.operators import consolidation, fx

ROWS = "file_id long, account_id long, txn_date date, row_index long, direction string, amount_paise long, balance_paise long, narration string"
DAY = dt.date(2024, 5, 1)


def test_look_alike_narrations_stay_apart(spark):
    rows = [
        (1, 1, DAY, 1, "debit", 100, None, "UPI-PAYTM-ALPHA"), (2, 1, DAY, 1, "debit", 100, None, "UPI-PAYTM-BETA"), (3, 1, DAY, 1, "debit", 100, None, "UPI-PAYTM-AL"), (4, 1, DAY, 1, "debit", 100, None, "NEFT 123456789 X"),
        (5, 1, DAY, 9, "debit", 100, None, "REF123456789"), (6, 1, DAY, 1, "debit", 100, None, "UPI"), (7, 1, DAY, 1, "debit", 100, None, "UPI"), (7, 1, DAY, 2, "debit", 100, None, "UPI"), (8, 1, DAY, 1, "debit", 100, 5, "UPI"), (9, 1, DAY, 1, None, 100, None, None),
    ]
    got = {(r.file_id, r.row_index): sorted((x.file_id, x.row_index) for x in r.lineage) for r in consolidation.merge_statements(spark.createDataFrame(rows, ROWS)).collect()}
    assert got == {(1, 1): [(1, 1), (3, 1)], (2, 1): [(2, 1)], (4, 1): [(4, 1), (5, 9)], (6, 1): [(6, 1), (7, 1)], (7, 2): [(7, 2)], (8, 1): [(8, 1)], (9, 1): [(9, 1)]}
    assert consolidation.merge_statements(spark.createDataFrame([], ROWS)).count() == 0


def test_rows_of_one_file_are_never_one(spark):
    """One short narration fits two long ones of another file: it joins one of them."""
    rows = [(1, 1, DAY, 1, "debit", 5, None, "ALPHA BETA ONE"), (1, 1, DAY, 2, "debit", 5, None, "ALPHA BETA TWO"), (2, 1, DAY, 1, "debit", 5, None, "ALPHA BETA"), (3, 1, DAY, 1, "debit", 5, None, "ALPHA BETA"), (3, 1, DAY, 2, "debit", 5, None, "ALPHA BETA")]
    got = consolidation.merge_statements(spark.createDataFrame(rows, ROWS)).collect()
    assert sorted(len(r.lineage) for r in got) == [1, 1, 3] or sorted(len(r.lineage) for r in got) == [2, 3]
    assert all(len({x.file_id for x in r.lineage}) == len(r.lineage) for r in got) and sum(len(r.lineage) for r in got) == 5


def test_file_numbers_come_again_in_other_accounts(spark):
    rows = [(1, 1, DAY, 1, "debit", 5, None, "ALPHA BETA ONE"), (2, 1, DAY, 1, "debit", 5, None, "ALPHA BETA"), (1, 2, DAY, 1, "debit", 6, None, "GAMMA DELTA"), (2, 3, DAY, 1, "debit", 7, None, "EPSILON ZETA")]
    merged = consolidation.merge_statements(spark.createDataFrame(rows, ROWS))
    assert sorted((r.account_id, r.file_id, r.narration, r.sources) for r in merged.collect()) == [(1, 1, "ALPHA BETA ONE", 2), (2, 1, "GAMMA DELTA", 1), (3, 2, "EPSILON ZETA", 1)]
    assert sorted((r.account_id, r.file_id, r.place) for r in consolidation.in_file_order(merged).collect()) == [(1, 1, 1), (2, 1, 1), (3, 2, 1)]


def by_heap(rows, files):
    """rows: uid -> (day, [(file, row)]); one account."""
    rank = {f: k for k, f in enumerate(sorted(files, key=lambda f: (min((row, rows[u][0]) for u in rows for g, row in rows[u][1] if g == f)[1], -sum(g == f for u in rows for g, _ in rows[u][1]), f)))}
    seen = {u: min((rank[f], r) for f, r in src) for u, (_, src) in rows.items()}
    after, waits = {u: set() for u in rows}, dict.fromkeys(rows, 0)
    for f in files:
        seq = [u for _, u in sorted((r, u) for u, (_, src) in rows.items() for g, r in src if g == f)]
        for a, b in zip(seq, seq[1:]):
            if b not in after[a] and rows[a][0] <= rows[b][0]:
                after[a].add(b)
                waits[b] += 1
    ready, out = [(rows[u][0], seen[u], u) for u in rows if not waits[u]], []
    heapq.heapify(ready)
    while ready:
        u = heapq.heappop(ready)[2]
        out.append(u)
        for v in after[u]:
            waits[v] -= 1
            if not waits[v]:
                heapq.heappush(ready, (rows[v][0], seen[v], v))
    return out + sorted(set(rows) - set(out), key=lambda u: (rows[u][0], seen[u]))


def test_order_of_files_by_brute_force(spark):
    """Random overlapping files of several accounts: the order of a heap over all constraints, days that fall included."""
    rng, data, want = random.Random(2), [], {}
    for account in range(12):
        n = rng.randrange(3, 14)
        base = [(DAY + dt.timedelta(i // 4), f"row number {account} {i}") for i in range(n)]
        files, rows = [], {}
        for f in range(3):
            file_id = account * 10 + f
            part = [i for i in range(n) if rng.random() < 0.7]
            if account % 4 == 3 and len(part) > 2:  # a file whose days fall somewhere
                part = part[2:] + part[:2]
            if part:
                files.append(file_id)
            for k, i in enumerate(part):
                data.append((file_id, account, base[i][0], k, "debit", 10, 1000 + i, base[i][1]))
                rows.setdefault(i, (base[i][0], []))[1].append((file_id, k))
        want[account] = [min(rows[u][1]) for u in by_heap(rows, files)]
    got = consolidation.in_file_order(consolidation.merge_statements(spark.createDataFrame(data, ROWS))).collect()
    for account, order in want.items():
        assert [(r.file_id, r.row_index) for r in sorted((r for r in got if r.account_id == account), key=lambda r: r.place)] == order


def test_conflicting_orders_go_by_first_appearance(spark):
    rows = [(1, 1, DAY, 1, "debit", 1, 1, "first row here"), (1, 1, DAY, 2, "debit", 2, 2, "second row here"), (2, 1, DAY, 1, "debit", 2, 2, "second row here"), (2, 1, DAY, 2, "debit", 1, 1, "first row here"), (2, 1, DAY, 3, "debit", 3, 3, "third row here")]
    got = consolidation.in_file_order(consolidation.merge_statements(spark.createDataFrame(rows, ROWS))).collect()
    assert {r.amount_paise for r in got} == {1, 2, 3} and sorted(r.place for r in got) == [1, 2, 3]


def test_flags_by_lineage_and_openings(spark):
    rows = [(1, 1, DAY, 1, "credit", 10, 110, "opening row of it"), (1, 1, DAY, 2, "credit", 10, 120, "shared row of it"), (2, 1, DAY, 1, "credit", 10, 120, "shared row of it"), (2, 1, DAY, 2, "credit", 10, 140, "late row of it"), (3, 1, DAY + dt.timedelta(9), 1, "credit", 5, 200, "other file of it")]
    df = spark.createDataFrame(rows, ROWS)
    merged = consolidation.in_file_order(consolidation.merge_statements(df))
    assert {tuple(r) for r in consolidation.balance_flags(merged, ["place"]).collect()} == {(1, 2, 2, "within_statement", 10), (1, 3, 1, "between_statements", 55)}
    printed = spark.createDataFrame([(1, 100), (2, 111), (3, None)], "file_id long, opening_paise long")
    assert {tuple(r) for r in consolidation.opening_flags(printed, df).collect()} == {(2, 111, 121, 120, -1)}


def test_refused_quotes_are_no_measure(spark):
    rates = [80, -1, 95, 84, 2000, 92, 93]
    q = spark.createDataFrame([("USD", DAY + dt.timedelta(i), r) for i, r in enumerate(rates)] + [("EUR", DAY, 90)], "code string, as_of date, inr_per_unit int").selectExpr("code", "as_of", "cast(inr_per_unit as decimal(20,8)) as inr_per_unit")
    got = {(r.code, r.as_of): r.reason for r in fx.vet_quotes(q).collect()}
    assert [got["USD", DAY + dt.timedelta(i)] for i in range(7)] == [None, "not_positive", "step_too_large", None, "out_of_band", None, None] and got["EUR", DAY] is None


def test_sides_by_place(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for file in range(6):
        held = 10_000
        for n in range(40):
            side = rng.choice(["debit", "credit"]) if file < 4 else "credit"
            paise = rng.randint(1, 500)
            held += paise if side == "credit" else -paise
            at = (300.0 if (side == "debit") == (file % 2 == 0) else 380.0) + rng.random() * 4
            # some steps are broken, some balances are missing
            rows.append((file, n, at, paise, None if n % 9 == 4 else held + (7 if n % 11 == 3 else 0), None))
            want[file, n] = (side, True)
    rows += [(7, 0, 300.0, 5, 100, None), (8, 0, 300.0, 5, None, None), (8, 1, 400.0, 5, None, None), (9, 0, None, 5, 100, None), (9, 1, 300.0, 5, 95, "credit"), (9, 2, 301.0, 5, 90, None)]
    # one place alone tells nothing; without votes the left column is debits; a told side stays; no place, no side
    want |= {(7, 0): (None, False), (8, 0): ("debit", True), (8, 1): ("credit", True), (9, 0): (None, False), (9, 1): ("credit", False), (9, 2): ("debit", True)}
    df = spark.createDataFrame(rows, "file int, n int, at double, amount_paise long, balance_paise long, direction string")
    assert {(r.file, r.n): (r.direction, r.by_place) for r in consolidation.sides_by_place(df).collect()} == want
    assert consolidation.sides_by_place(df.where("false")).count() == 0


def test_rows_without_a_pair_are_left_out_of_rounds(spark, monkeypatch):
    """A table of forms written anew in each round, whatever joined, made rounds as dear as the whole."""
    kept, store = {}, consolidation.stored
    def spy(df, name):
        out = store(df, name)
        kept.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(consolidation, "stored", spy)
    rows = [(1, 1, DAY, i, "debit", i, None, f"NUMBER {i} OF MANY") for i in range(50)] + [(f, 1, DAY, 0, "debit", 7, None, "NUMBER 7 OF MA" + "NY"[:f - 2]) for f in (2, 3, 4)]
    got = consolidation.merge_statements(spark.createDataFrame(rows, ROWS))
    assert sorted(r.sources for r in got.collect()) == [1] * 49 + [4]
    assert kept["forms"] == [52] and max(kept["paired-forms"]) <= 4


def test_days_out_of_order_need_no_group_each(spark, capsys):
    """A pandas group for each day of an account took most of the time."""
    rows = [r for a in range(3) for r in ((1, a, DAY, 1, "debit", 1, 1, "first row here"), (1, a, DAY, 2, "debit", 3, 3, "third row here"), (2, a, DAY, 1, "debit", 2, 2, "second row here"), (2, a, DAY, 2, "debit", 3, 3, "third row here"))]
    got = consolidation.in_file_order(consolidation.merge_statements(spark.createDataFrame(rows, ROWS)))
    assert sorted((r.account_id, r.place, r.amount_paise) for r in got.collect()) == [(a, i, i) for a in range(3) for i in (1, 2, 3)]
    got.explain()
    assert "InPandas" not in capsys.readouterr().out
