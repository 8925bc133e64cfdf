"""Cells, alerts and narrations on small cases; series and payers by brute force."""

import datetime

from pyspark.sql import functions as F

from ledgerloom.functions import narration, text
from ledgerloom.operators import alerts, classify, consolidation, matching


def _one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("x")).first().x


def test_dates(spark):
    f = lambda c: text.date(c, last_year=2027, this_year=2026)
    day = datetime.date
    for cell, want in [("1/2/2024", day(2024, 2, 1)), ("01Jan24", day(2024, 1, 1)), ("3.4.99", day(1999, 4, 3)), ("Jan 05, 2024", day(2024, 1, 5)), ("7 March 2020", day(2020, 3, 7)), ("05 jan", day(2026, 1, 5)), ("30/02/2024", None), ("1/1/1989", None), ("2031-01-01", None), ("", None), (None, None), ("soon", None)]:
        assert _one(spark, cell, f) == want, cell
    assert _one(spark, "05 Jan", lambda c: text.date(c)) is None


def test_ocr_and_skeleton(spark):
    for cell, want in [("1O,OOO.OO", "10,000.00"), ("UPI-BOOKMYSHOW-554O", "UPI-BOOKMYSHOW-5540"), ("ISO SOS", "ISO SOS"), ("a \t b", "a b"), ("", ""), (None, None)]:
        assert _one(spark, cell, narration.ocr_clean) == want
    assert _one(spark, "Shekhar", text.skeleton) == _one(spark, "SHEKAR", text.skeleton) == "SKR"
    assert _one(spark, "Haha", text.skeleton) == "H"


def test_foreign_leg(spark):
    def leg(said, booked=None):
        x = _one(spark, said, lambda c: narration.fx_leg(c, F.lit(booked).cast("long")))
        return x and (x.currency, x.amount_minor, x.rate and float(x.rate))

    assert leg("CARD USD 13,079.09 @ 88.71", 116024607) == ("USD", 1307909, 88.71)
    assert leg("USD 100.00 @ 88.71", 500000) is None
    assert leg("SWIFT CHARGES USD 25.00") is None and leg("ZAR 10.00") is None and leg(None) is None and leg("") is None
    assert leg("USD 306.36 MANAGEMENT FEE RECEIPT") == ("USD", 30636, None)
    assert leg("5000.00 JPY") == ("JPY", 5000, None)


def test_party(spark):
    for said, want in [("UPI/DR/123456789012/Meyer Organics Pvt Ltd/HDFC", "MEYER ORGANICS"), ("NEFT-AXIS0001234-ACME & SONS-STATE B", "ACME & SONS"), ("ATM WDL 123", None), ("IMPS-07:22:38", None), ("", None), (None, None)]:
        assert _one(spark, said, narration.party) == want, said


def test_alerts(spark):
    rows = [("a@axisbank.com", None, None), (None, "x", "Rs 5 debited"), ("a@sbi.co.in", "Account statement", "is ready"), ("a@sbi.co.in", "", "Your account statement: Rs 5 credited"), ("a@sbi.co.in", "", "balance is Rs 3"), ("a@pnb.co.in", "Txn", "Rs 1,234.5 received before Rs 9 debited, card ending 4321")]
    got = [tuple(r) for r in alerts.parse(spark.createDataFrame(rows, "sender string, subject string, body string")).select("verdict", "direction", "amount_paise", "last4").collect()]
    assert got == [("no_verb", None, None, None), ("sender", None, None, None), ("statement", None, None, None), ("alert", "credit", 500, None), ("no_verb", None, None, None), ("alert", "credit", 123450, "4321")]


def test_salary_payers_by_definition(spark):
    import random

    r = random.Random(5)
    rows = [(r.randrange(3), "credit", round(100000 * 1.02 ** r.uniform(0, 6)), r.choice("ABCDEFGHIJKL"), r.random() < 0.15) for _ in range(120)]
    df = spark.createDataFrame(rows, "account_id long, direction string, amount_paise long, who string, lab boolean")
    got = {(x.account_id, x.payer, x.n) for x in consolidation.salary_payers(df, F.col("who"), F.col("lab")).collect()}
    want = set()
    for key in {(a, p) for a, _, _, p, _ in rows}:
        mine = [x[2] for x in rows if (x[0], x[3]) == key]
        paid = [x[2] for x in rows if x[0] == key[0] and x[4]]
        if len(mine) > 1 and all(any(abs(m - s) * 100 <= 2 * s for s in paid) for m in mine):
            want.add((*key, len(mine)))
    assert got == want and want


def test_decisions(spark):
    c = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (3, 3)], "txn_id long, book_id long")
    d = spark.createDataFrame([([1], [1, 9], "rejected"), ([3], [7], "confirmed")], "txn_ids array<long>, book_ids array<long>, status string")
    assert sorted(map(tuple, matching.replay_decisions(c, d).collect())) == [(1, 2), (2, 2)]
    rows = spark.createDataFrame([("p", None, None, None, None), ("p", "Old", False, None, None), ("q", None, True, None, None), (None, None, None, None, None)], "party_key string, category string, needs_review boolean, method string, confidence double")
    got = classify.propagate(rows, spark.createDataFrame([("p", "New")], "party_key string, category string"))
    assert sorted((x.party_key or "", x.category or "", x.method or "") for x in got.collect()) == [("", "", ""), ("p", "New", "counterparty_memory"), ("p", "Old", ""), ("q", "", "")]


def test_alert_fields_by_neighbouring_words(spark):
    said = [
        ("Rs.1,250.50 debited from A/c no. XX1234 on 05-Jan-2024 to shop.name@okbank. UPI Ref No: 412345678901. Avail Bal: Rs 9,000", 125050, "1234", "shop.name@okbank", 900000, "412345678901", "05-Jan-2024"),
        ("INR 500 paid to BLUE HARBOUR & CO on 5 Feb 24 ref AB12CD34. Balance is INR 10.5", 50000, None, "BLUE HARBOUR & CO", 1050, "AB12CD34", "5 Feb 24"),
        ("₹75 spent using card ending 9876 at TEA HOUSE.", 7500, "9876", "TEA HOUSE", None, None, None),
        ("credited to account **4321 Rs 12.345", None, "4321", None, None, None, None),
        ("paid", None, None, None, None, None, None),
    ]
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(said)], "i int, said string")
    got = df.select("i", *[c.alias(k) for k, c in alerts.fields(F.col("said")).items()]).orderBy("i").collect()
    assert [(r.amount_paise, r.last4, r.party, r.balance_paise, r.reference_no, r.day_text) for r in got] == [x[1:] for x in said]


def test_a_message_is_cut_into_tokens_once(spark):
    """The plan of alerts.parse splits the message at blanks at one place, however many fields read its tokens."""
    df = spark.createDataFrame([("a@axisbank.com", "", "INR 10 debited from A/C XX1234")], "sender string, subject string, body string")
    plan = alerts.parse(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(regexp_replace(regexp_replace(") == 1


def test_a_cell_of_a_date_is_found_once_and_shapes_leave_no_day_out(spark):
    """text.date has its cell at one place of the plan; every way to write a day that the formats alone parse is still read."""
    df = spark.range(1).select(F.concat(F.lit("1/2/"), F.col("id") + 2000).alias("c"))
    assert df.select(text.date(F.reverse("c")).alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("reverse(") == 1
    cells = ["01/02/2003", "1/2/2003", "001/2/2003", "1-02-2003", "1.2.2003", "2003-2-1", "2003/02/01", "+02003-2-1", "1/2/03", "1-2-70", "1.2.68", "1 Feb 2003", "1 february 2003", "1-FEB-2003", "1-feb-03", "1Feb2003", "1Feb03", "Feb 1, 2003", "Feb 1 2003", "20030201",
             "1 Feb", "Feb 1", " 1/2/2003 ", "1/2/2003x", "1 / 2 / 2003", "32/1/2003", "1/2/1889", "-1/2/2003", "", "Feb", "2003", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    alone = lambda f: F.try_to_timestamp(F.trim("c"), F.lit(f)).cast("date")
    early = lambda d, f: F.when(F.year(d) >= 2069, F.add_months(d, -1200)).otherwise(d) if "yyyy" not in f else d
    tried = [early(alone(f), f) for f in text.DATE_FORMATS] + [F.try_to_timestamp(F.concat(F.trim("c"), F.lit(" 2000")), F.lit(f"{f} yyyy")).cast("date") for f in text.YEARLESS]
    got = rows.select("c", text.date(F.col("c"), this_year=2000).alias("x"), F.coalesce(*[F.when(F.year(t).between(1990, 2100), t) for t in tried]).alias("y")).collect()
    assert [r for r in got if r.x != r.y] == []
    assert sum(r.x is not None for r in got) >= 18
