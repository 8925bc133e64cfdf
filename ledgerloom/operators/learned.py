"""A learned category model over narrations, checks of its training data, and the decision between rules and model.

The model is a pyspark.ml pipeline: words and pairs of words, their presence weighted by inverse document frequency,
scaled to length one, into a multinomial logistic regression. Narrations repeat, so that each different text is scored once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, Normalizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import stored

#: Scores of strong and medium rules, the model's confidences, what must be known of a text, and the scale of rule scores.
RULE_HIGH, RULE_MEDIUM, RULE_CLEAR = 80, 50, 100
MODEL_ACCEPTED, MODEL_STRONG, LEAST_KNOWN, LEAST_COVERAGE = 0.70, 0.85, 2, 0.5
RULE_SCALE, MOST_CONFIDENCE = 110.0, 0.99
#: Words that say nothing about a category.
GENERIC = """
account and bank branch cheque clg co company corp cr dr enterprises for from holdings inc india indian industries inw limited llp ltd
mmt online otw pvt pvtltd the to transaction ventures
""".split()


def words(narration: Column) -> Column:
    """Lower-case words of letters, of two letters and more."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(narration, F.lit(""))), "[^a-z]+", " "), " "), lambda w: F.length(w) >= 2)


def template(narration: Column) -> Column:
    """What narrations of one making share: their words."""
    return F.array_join(words(narration), " ")


def _terms(texts: DataFrame) -> DataFrame:
    """texts with `terms`: the words and the pairs of neighbours of its column `text`."""
    w = F.filter(F.split("text", " "), lambda x: x != "")
    pairs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(w, i + 1)))
    return texts.withColumn("terms", F.concat(w, pairs))


@dataclass
class Model:
    """A fitted pipeline; save() and load() keep it in any folder that Spark reaches."""

    pipeline: PipelineModel

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(path)

    @classmethod
    def load(cls, path: str) -> Model:
        return cls(PipelineModel.load(path))

    @property
    def labels(self) -> list[str]:
        return self.pipeline.stages[0].labels

    def vocabulary(self, spark) -> DataFrame:
        """word: the single words that the model has seen; at most as many as fit() allows terms."""
        return spark.createDataFrame([(w,) for w in self.pipeline.stages[1].vocabulary if " " not in w], "word string")

    def predict(self, rows: DataFrame, narration: str = "narration") -> DataFrame:
        """rows with ml_category, ml_confidence, ml_top (three categories and probabilities), known_words and told_words.

        Told words are those of the text that are not generic; known ones those that the model has seen. A text without
        words has no prediction. Every different text is scored once and joined back.
        """
        keyed = rows.withColumn("text_", template(F.col(narration)))
        texts = keyed.select(F.col("text_").alias("text")).where("text <> ''").distinct()
        # the label is only needed to pass the indexer, which skips nothing
        scored = self.pipeline.transform(_terms(texts).withColumn("category", F.lit(self.labels[0])))
        names = F.array(*map(F.lit, self.labels))
        ranked = F.reverse(F.array_sort(F.zip_with(vector_to_array("probability"), names, lambda p, c: F.struct(p.alias("p"), c.alias("category")))))
        scored = scored.select("text", F.slice(ranked, 1, 3).alias("top"))
        told = texts.select("text", F.explode(F.filter(F.split("text", " "), lambda w: (w != "") & ~w.isin(GENERIC))).alias("word"))
        seen = self.vocabulary(rows.sparkSession).withColumn("seen", F.lit(1))
        counts = told.join(seen, "word", "left").groupBy("text").agg(F.count("seen").alias("known_words"), F.count(F.lit(1)).alias("told_words"))
        found = scored.join(counts, "text", "left").select(F.col("text").alias("text_"), F.col("top")[0]["category"].alias("ml_category"), F.col("top")[0]["p"].alias("ml_confidence"), F.col("top").alias("ml_top"), F.coalesce("known_words", F.lit(0)).alias("known_words"), F.coalesce("told_words", F.lit(0)).alias("told_words"))
        return keyed.join(found, "text_", "left").drop("text_")


def fit(examples: DataFrame, reg: float = 0.001, most_terms: int = 1 << 15, most_iterations: int = 60) -> Model:
    """A model of examples(narration, category): one example for each different template and category; `most_terms` commonest terms."""
    texts = examples.where("narration is not null and category is not null").select(template(F.col("narration")).alias("text"), F.col("category")).where("text <> ''").distinct()
    stages = [
        StringIndexer(inputCol="category", outputCol="label", stringOrderType="alphabetAsc"), CountVectorizer(inputCol="terms", outputCol="present", binary=True, vocabSize=most_terms),
        IDF(inputCol="present", outputCol="weighted"), Normalizer(inputCol="weighted", outputCol="features"), LogisticRegression(maxIter=most_iterations, regParam=reg, family="multinomial"),
    ]
    # each stage reads the examples again, the regression many times: only their different texts are kept for that
    return Model(Pipeline(stages=stages).fit(stored(_terms(texts), "examples")))


def held_out(template_: Column, seed: int, percent: int = 20) -> Column:
    """Whether a template is held out in split `seed`: all its rows are, or none."""
    return F.pmod(F.xxhash64(template_, F.lit(seed)), F.lit(100)) < percent


def macro_f1(predictions: DataFrame, truth: str = "category", predicted: str = "ml_category") -> float:
    """Mean F1 over the true categories; a row without a prediction counts as a miss."""
    n = predictions.groupBy(truth, predicted).count()
    right = F.sum(F.when(F.col(truth) == F.col(predicted), F.col("count")).otherwise(0))
    real = n.groupBy(F.col(truth).alias("c")).agg(F.sum("count").alias("real"), right.alias("hit"))
    said = n.groupBy(F.col(predicted).alias("c")).agg(F.sum("count").alias("said"))
    f1 = real.join(said, "c", "left").select((2 * F.col("hit") / (F.col("real") + F.coalesce("said", F.lit(0)))).alias("f1"))
    return f1.agg(F.avg("f1")).first()[0]


def choose(examples: DataFrame, regs: tuple[float, ...] = (0.0001, 0.001, 0.01), splits: int = 10, percent: int = 20) -> tuple[float, dict[float, float]]:
    """The regularisation of best mean macro F1 over splits held out by template, and all means."""
    t = template(F.col("narration"))
    means = {}
    for reg in regs:
        scores = []
        for seed in range(splits):
            test = examples.where(held_out(t, seed, percent))
            scores.append(macro_f1(fit(examples.where(~held_out(t, seed, percent)), reg).predict(test)))
        means[reg] = sum(scores) / len(scores)
    return max(means, key=lambda r: (means[r], r)), means


def training_problems(train: DataFrame, test: DataFrame) -> DataFrame:
    """problem, item, n of examples(narration, category): templates on both sides (leak), templates of several categories
    (conflict), categories of the test that training lacks (unseen)."""
    t = template(F.col("narration")).alias("item")
    leak = train.select(t).distinct().join(test.select(t), "item").groupBy("item").count().select(F.lit("leak").alias("problem"), "item", F.col("count").alias("n"))
    conflict = train.unionByName(test).select(t, "category").distinct().groupBy("item").count().where("count > 1").select(F.lit("conflict").alias("problem"), "item", F.col("count").alias("n"))
    unseen = test.groupBy("category").count().join(train.select("category").distinct(), "category", "left_anti").select(F.lit("unseen").alias("problem"), F.col("category").alias("item"), F.col("count").alias("n"))
    return leak.unionByName(conflict).unionByName(unseen)


def collapse(predictions: DataFrame, categories: int, most_share: float, least_classes: float) -> DataFrame:
    """One row: the commonest prediction, its share, the number of predicted categories, and whether a model has collapsed
    onto few: a share above most_share, or fewer than least_classes of all categories ever predicted."""
    n = predictions.where("ml_category is not null").groupBy("ml_category").count()
    x = n.agg(F.max_by("ml_category", F.struct("count", "ml_category")).alias("top"), (F.max("count") / F.sum("count")).alias("share"), F.count(F.lit(1)).alias("classes"))
    return x.withColumn("collapsed", F.coalesce((F.col("share") > most_share) | (F.col("classes") < least_classes * categories), F.lit(True)))


def decide(rows: DataFrame) -> DataFrame:
    """rows with category, method, confidence, agreement and needs_review from rule_category, rule_score, rule_ambiguous,
    ml_category, ml_confidence, known_words, told_words and, where there are such columns, fallback_category and fallback_confidence.

    A clear rule of 80 and more stands, except against a sure model while it is below 100: then nobody decides. A rule of 50
    to 79 needs the model's consent, or yields to a sure one. Alone the model needs 0.70. The model has a say only on texts
    of which it knows two words and half of those told; only its consent with a strong rule counts on any. What is open
    takes the fallback, else a review.
    """
    score = F.coalesce("rule_score", F.lit(0))
    rule, ml = F.when(score > 0, F.col("rule_category")), F.col("ml_category")
    surely = lambda c: F.coalesce(c, F.lit(False))
    familiar = surely((F.col("known_words") >= LEAST_KNOWN) & (F.col("known_words") >= F.col("told_words") * LEAST_COVERAGE) & ml.isNotNull())
    accepted, strong = (familiar & surely(F.col("ml_confidence") >= at) for at in (MODEL_ACCEPTED, MODEL_STRONG))
    high = rule.isNotNull() & (score >= RULE_HIGH) & ~surely(F.col("rule_ambiguous"))
    medium = rule.isNotNull() & (score >= RULE_MEDIUM) & (score < RULE_HIGH)
    agree = surely(rule == ml)
    case = (
        F.when(high & agree | medium & agree & accepted, "hybrid").when(high & strong & (score < RULE_CLEAR), "unresolved").when(high, "rule")
        .when(medium & strong | ~medium & accepted, "ml").otherwise("open")
    )
    spare = F.col("fallback_category") if "fallback_category" in rows.columns else F.lit(None).cast("string")
    sure = F.col("fallback_confidence").cast("double") if "fallback_confidence" in rows.columns else F.lit(None).cast("double")
    method = F.when(case != "open", case).when(spare.isNotNull(), "fallback").otherwise("unresolved")
    rule_confidence = F.round(F.least(score / RULE_SCALE, F.lit(MOST_CONFIDENCE)), 4)
    x = rows.withColumn("method", method)
    picked = lambda both, by_rule, by_model, by_spare: F.when(F.col("method") == "hybrid", both).when(F.col("method") == "rule", by_rule).when(F.col("method") == "ml", by_model).when(F.col("method") == "fallback", by_spare)
    agreement = F.when(F.col("method") == "unresolved", "none").when(agree, "agree").when(rule.isNotNull() & ml.isNotNull(), "disagree").when(rule.isNotNull(), "rule_only").when(ml.isNotNull(), "ml_only").otherwise("none")
    return x.withColumns({
        "category": picked(rule, rule, ml, spare), "confidence": picked(F.greatest(rule_confidence, F.col("ml_confidence")), rule_confidence, F.col("ml_confidence"), sure),
        "agreement": agreement, "needs_review": F.col("method") == "unresolved",
    })
