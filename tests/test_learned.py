"""The learned category model on planted narrations, its checks, and the decision table row by row."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import learned

WORDS = {
    "Fuel": ["petrol pump", "fuel station", "diesel outlet", "petroleum filling"], "Rent": ["house rent", "office rent", "rent lease", "monthly rent"], "Salary": ["salary credit", "payroll salary", "wages salary", "salary staff"],
    "Food": ["pizza restaurant", "restaurant dining", "food delivery", "restaurant cafe"],
}


@pytest.fixture(scope="module")
def examples(spark):
    rng, rows = random.Random(7), []
    for category, phrases in WORDS.items():
        for _ in range(120):
            some = rng.sample(phrases, 2)
            rows.append((f"{rng.choice(['UPI', 'NEFT', 'IMPS'])}/{rng.randrange(10**9)}/{rng.choice(['alpha', 'bravo', 'delta', 'metro', 'royal', 'sunrise', 'city'])} {some[0]} {some[1]}/{rng.choice(['mumbai', 'pune', 'delhi', 'goa'])}", category))
    return spark.createDataFrame(rows, "narration string, category string").repartition(3).cache()


def test_held_out_templates_are_predicted_and_models_reload(spark, examples, tmp_path):
    best, means = learned.choose(examples, regs=(0.001, 10.0), splits=2)
    assert means[best] == max(means.values()) > 0.95
    model = learned.fit(examples, 0.001)
    model.save(str(tmp_path / "model"))
    rows = spark.createDataFrame([(1, "UPI/77/metro petrol pump", 0), (2, "12345", 0), (3, None, 0), (4, "qwerty zxcvb rent", 0), (5, "UPI/78/metro PETROL pump", 0)], "id int, narration string, terms int")
    a, b = ({r.id: r for r in m.predict(rows).collect()} for m in (model, learned.Model.load(str(tmp_path / "model"))))
    assert a.keys() == {1, 2, 3, 4, 5} and all(a[i].ml_category == b[i].ml_category for i in a)
    assert a[1].ml_category == "Fuel" and (a[1].known_words, a[1].told_words) == (4, 4) and len(a[1].ml_top) == 3 and a[5].ml_confidence == a[1].ml_confidence
    assert a[2].ml_category is a[3].ml_category is None and (a[4].known_words, a[4].told_words) == (1, 3)


def test_training_checks(spark):
    schema = "narration string, category string"
    train = spark.createDataFrame([("UPI/1/shop", "A"), ("UPI/2/shop", "B"), ("rent", "A")], schema)
    test = spark.createDataFrame([("UPI/9/shop", "A"), ("fuel", "C")], schema)
    assert {tuple(r) for r in learned.training_problems(train, test).collect()} == {("leak", "upi shop", 1), ("conflict", "upi shop", 2), ("unseen", "C", 1)}
    p = spark.createDataFrame([("A",)] * 9 + [("B",)], "ml_category string")
    assert learned.collapse(p, 4, 0.8, 0.25).first().collapsed and not learned.collapse(p, 4, 0.95, 0.25).first().collapsed and learned.collapse(p, 10, 0.95, 0.5).first().collapsed
    assert learned.collapse(p.limit(0), 4, 0.8, 0.25).first().collapsed


#: rule, score, ambiguous, model, its confidence, known, told, fallback -> method, category, needs review
TABLE = [
    ("A", 110, False, "A", 0.20, 0, 3, None, "hybrid", "A", False), ("A", 110, False, "B", 0.99, 3, 3, None, "rule", "A", False), ("A", 90, False, "B", 0.99, 3, 3, None, "unresolved", None, True),
    ("A", 90, False, "B", 0.99, 1, 3, None, "rule", "A", False), ("A", 90, False, "B", 0.84, 3, 3, None, "rule", "A", False), ("A", 80, False, None, None, None, None, None, "rule", "A", False),
    ("A", 90, True, "B", 0.75, 3, 3, None, "ml", "B", False), ("A", 79, False, "A", 0.70, 2, 4, None, "hybrid", "A", False), ("A", 79, False, "A", 0.69, 2, 4, None, "unresolved", None, True),
    ("A", 50, False, "B", 0.85, 2, 4, None, "ml", "B", False), ("A", 50, False, "B", 0.84, 2, 4, "C", "fallback", "C", False), ("A", 49, False, "B", 0.70, 2, 4, None, "ml", "B", False),
    (None, None, None, "B", 0.70, 2, 5, None, "unresolved", None, True), (None, 0, False, None, None, 0, 0, "C", "fallback", "C", False), (None, None, None, None, None, None, None, None, "unresolved", None, True),
]


def test_decision_table(spark):
    df = spark.createDataFrame([(i, *r[:8], None if r[7] is None else 0.62) for i, r in enumerate(TABLE)], "i int, rule_category string, rule_score int, rule_ambiguous boolean, ml_category string, ml_confidence double, known_words int, told_words int, fallback_category string, fallback_confidence double")
    got = [tuple(r) for r in learned.decide(df).orderBy("i").select("method", "category", "needs_review").collect()]
    assert got == [r[8:] for r in TABLE]


def test_fit_reads_its_examples_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def said(i):
        read.add(1)
        return ("petrol pump ", "house rent ")[i % 2] + "abcdefghij"[i % 10] * 3

    learned.fit(spark.range(40).select(said("id").alias("narration"), F.when(F.col("id") % 2 == 0, "Fuel").otherwise("Rent").alias("category")))
    assert read.value <= 80
