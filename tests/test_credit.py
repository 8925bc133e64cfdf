"""Blocks by account, reports, the category tree and name similarity on small hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import credit, matching, reports, similarity, tree

COLS = "txn_id long, account_id long, direction string, debit_paise long, credit_paise long, amount_paise long, signed_paise long, txn_date date, counterparty string, narration string, balance_paise long"


def ledger(spark, rows):
    """(id, account, signed, date, party, narration) with a running balance in row order."""
    out, have = [], {}
    for i, a, v, d, p, n in rows:
        have[a] = have.get(a, 0) + v
        out.append((i, a, "credit" if v > 0 else "debit", -v if v < 0 else None, v if v > 0 else None, abs(v), v, d, p, n, have[a]))
    return spark.createDataFrame(out, COLS)


@pytest.fixture(scope="module")
def half_year(spark):
    rows, i = [], 0
    for m in range(1, 8):
        for v, day, p, n in ((8_000_000, 1, "ACME", "SALARY CREDIT ACME"), (-1_000_000, 5, "BANK", "EMI HOME LOAN"), (-1_500_000, 3, "OWNER", "NEFT RENT"), (-700_000, 9, "CLUB", None)):
            i += 1
            rows.append((i, 1, v, dt.date(2024, m, day), p, n))
    return ledger(spark, rows)


def test_salary_and_obligations(half_year):
    assert [tuple(r) for r in credit.salary(half_year).collect()] == [(1, 92, 8_000_000, "ACME")]
    got = {r.counterparty: (r.monthly_paise, r.confidence) for r in credit.obligations(half_year).collect()}
    assert got == {"BANK": (1_000_000, 90), "OWNER": (1_500_000, 55), "CLUB": (700_000, 55)}


def test_affordability(half_year):
    r = credit.affordability(half_year).first()
    assert (r.income_paise, r.debt_paise, r.essential_paise, r.ratio_bp, r.verdict) == (8_000_000, 3_200_000, 2_500_000, 4000, "marginal")


def test_blocks_on_nothing(spark, half_year):
    none = half_year.where("false")
    for f in (credit.salary, credit.income, credit.expenses, credit.obligations, credit.affordability, credit.history_warnings, reports.party_groups):
        assert f(none).count() == 0
    assert credit.risk(none, "2024-08-01").count() == 0
    r = credit.affordability(half_year.where("direction = 'debit'")).first()
    assert r.verdict == "insufficient_data" and r.ratio_bp is None


def test_risk_and_history(spark):
    t = ledger(spark, [(1, 7, -500, dt.date(2024, 1, 1), "A", "PENAL INTEREST"), (2, 7, 900, dt.date(2024, 1, 5), "A", "CASH DEP"), (3, 7, -100, dt.date(2024, 1, 8), "A", None)])
    r = credit.risk(t, "2024-02-01", 350).first()
    assert (r.days, r.negative_days, r.breach_days, r.charges, r.charges_paise) == (8, 4, 5, 1, 500)
    assert r.stress_bp == 3500 // 6 + 2500 * 4 // 8 + 2000 * 5 // 8 + 2000 * min(r.weighted, 8) // 8
    assert credit.history_warnings(t).first().warnings == "short_history,sparse_history"


def test_reports(spark, half_year):
    rows = reports.period_report(half_year, "2024-02-01", "2024-04-01", "debit").collect()
    assert len(rows) == 6 and {r.total_paise for r in rows} == {6_400_000}
    g = {r.counterparty: r for r in reports.party_groups(half_year).collect()}
    assert (g["BANK"].n, g["BANK"].spellings, g["BANK"].samples) == (7, 1, "EMI HOME LOAN")
    assert (g["CLUB"].spellings, g["CLUB"].samples) == (0, None)


def test_tree(half_year):
    placed = tree.place(half_year)
    top = {r.child: (r.n, r.has_children) for r in tree.drilldown(placed).collect()}
    assert top == {"Income": (7, True), "Housing": (14, True), "Other": (7, True)}
    assert {r.child: r.has_children for r in tree.drilldown(placed, "Housing").collect()} == {"Loan": True, "Rent": False}
    assert [r.child for r in tree.drilldown(placed, "Housing>Rent").collect()] == [None]
    assert [r.txn_id for r in tree.rows_at(placed, "Income", 1, 2).collect()] == [21, 17]


def test_similarity(spark):
    x = spark.createDataFrame([("MARTHA", "MARHTA"), ("", "A"), (None, "A"), ("AB", "AB"), ("", "")], "a string, b string")
    got = [r.s for r in x.select(F.round(similarity.jaro_winkler("a", "b"), 4).alias("s")).collect()]
    assert got == [0.9611, 0.0, None, 1.0, 0.0]
    d = spark.createDataFrame([("abcd", "bcde"), ("ab", "")], "a string, b string").select(similarity.dice(similarity.trigrams(F.col("a")), similarity.trigrams(F.col("b"))).alias("d"))
    assert [r.d for r in d.collect()] == [5000, None]
    t = spark.createDataFrame([(1, 1), (1, 1), (1, 2), (2, 2)], "c int, t int")
    assert tuple(similarity.against_truth(t, "c", "t").first()) == (1, 3, 2, 3333, 5000)
    assert similarity.against_truth(t.where("false"), "c", "t").first().precision_bp is None


def test_other_amounts(spark):
    d = dt.date(2024, 1, 10)
    book = spark.createDataFrame([(1, 1, "debit", d, 100, "R1"), (2, 1, "debit", d, 100, None), (3, 1, "debit", d, 50, "R2")], "book_id long, account_id long, direction string, entry_date date, amount_paise long, instrument_no string")
    bank = spark.createDataFrame([(11, 1, "debit", d, 130, "R1"), (12, 1, "debit", d, 110, "R1"), (13, 1, "debit", d, 50, "R2"), (14, 1, "debit", d, 9, None)], "txn_id long, account_id long, direction string, txn_date date, amount_paise long, reference_no string")
    assert [tuple(r) for r in matching.other_amounts(book, bank).collect()] == [(1, 12, 10)]
