"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges(a, b): root is the smallest node that it reaches.

    Each round only groups with partial sums and joins with a stored table of smallest neighbours, so
    that adaptive skew handling can split a node with very many links; rounds grow with the logarithm of
    the longest chain. Every round's table is written to shared storage, and deleted once the next one is
    there; the rounds end when one changes no row. Null ends and self-links are ignored; an empty table
    gives no rows.
    """
    e = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    e = stored(e, "edges")
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "smallest")
        large = stored(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "smallest")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        new = stored(small.select("x.u", "x.v").where("u > v").distinct(), "edges")
        settled = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(e, low, large, least)
        e = new
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
