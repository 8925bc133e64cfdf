"""Name similarity measures and scoring of assignments against known groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import text
from ..plans.scratch import ship_package


def _jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, left = [False] * len(b), []
    for i, x in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if not used[j] and b[j] == x), None)
        if j is not None:
            used[j] = True
            left.append(x)
    m = len(left)
    if not m:
        return 0.0
    moved = sum(x != y for x, y in zip(left, (y for y, u in zip(b, used) if u))) // 2
    base = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return base + prefix * 0.1 * (1 - base) if base >= 0.7 else base


@F.pandas_udf(DoubleType())
def _scores(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def jaro_winkler(a: Column | str, b: Column | str) -> Column:
    """Jaro-Winkler: a common prefix of up to 4 counts where the base is at least 0.7; null for nulls. No built-in has it."""
    ship_package(SparkSession.active())
    return _scores(a, b)


def trigrams(c: Column) -> Column:
    """The different three-character runs of the upper-cased text's letters and digits."""
    s = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    return F.when(F.length(s) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substring(s, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays in basis points (floor); null where both are empty."""
    both = F.size(a) + F.size(b)
    return F.when(both > 0, F.floor(F.size(F.array_intersect(a, b)) * 20000 / both)).cast("long")


def against_truth(df: DataFrame, cluster: str, truth: str) -> DataFrame:
    """One row: pairs that cluster, truth and both put together, precision and recall in basis points (floor)."""
    n = lambda g: g.agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("v"))
    cells = df.groupBy(cluster, truth)
    x = n(cells).select(F.col("v").alias("together"), n(df.groupBy(cluster)).scalar().alias("predicted"), n(df.groupBy(truth)).scalar().alias("actual"))
    return x.select("*", F.expr("case when predicted > 0 then together * 10000 div predicted end").alias("precision_bp"), F.expr("case when actual > 0 then together * 10000 div actual end").alias("recall_bp"))


def merge_suggestions(names: DataFrame, name: str, least: int = 8) -> DataFrame:
    """kind, key, names, keep: groups of different names whose letters and digits start with the same `least` characters
    (kind prefix), or whose consonant skeletons of three letters and more are equal (kind skeleton)."""
    prefix = F.substring(F.regexp_replace(F.upper("name"), "[^A-Z0-9]", ""), 1, least)
    keys = F.array(F.struct(F.lit("prefix").alias("kind"), prefix.alias("key")), F.struct(F.lit("skeleton").alias("kind"), text.skeleton(F.col("name")).alias("key")))
    x = names.select(F.col(name).alias("name")).where("name is not null").distinct().select("name", F.inline(keys))
    x = x.where(F.length("key") >= F.when(F.col("kind") == "prefix", least).otherwise(3))
    return x.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("names"), F.min("name").alias("keep")).where("names > 1")


def edit_ratios(names: DataFrame, name: str, prefix: int = 5) -> DataFrame:
    """a_name, b_name, ratio in thousandths: edit distance of different compact names that share a prefix."""
    x = names.select(F.replace(F.upper(name), F.lit(" ")).alias("x")).where("x is not null").distinct().withColumn("p", F.substring("x", 1, prefix))
    size = F.greatest(F.length("a_name"), F.length("b_name"))
    pairs = x.withColumnRenamed("x", "a_name").join(x.withColumnRenamed("x", "b_name"), "p").where("a_name < b_name")
    return pairs.select("a_name", "b_name", F.floor((size - F.levenshtein("a_name", "b_name")) * 1000 / size).cast("long").alias("ratio"))
