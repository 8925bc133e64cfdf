"""Minimax contiguous sharding.

Equal texts form an atomic group; groups stand in a fixed order (hash bucket, then text hash). The
smallest shard capacity for which a greedy left-to-right fill needs at most `shards` shards is found by
binary search, and the order is cut at that capacity: each cut is the group's end nearest to an equal
share of what is left, within the capacity, and such that the rest still fits. Spark holds the groups and their running sums; the driver
only sees cumulative sums of *units* (runs of neighbouring groups): first one unit for each bucket, then,
only where a cut may fall, units up to 64 times finer, until those are single groups. So the capacity is
exact, and the driver's share is bounded: one sum for each of at most 2^18 buckets, and about
shards^2 * 64 a level.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, total

_FINER = 64


def _greedy(ends: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """Cut positions (cumulative sums) of a greedy fill, or None if `shards` don't suffice."""
    cuts, at, last = [], 0, int(ends[-1]) if len(ends) else 0
    for _ in range(shards):
        if at >= last:
            break
        i = int(np.searchsorted(ends, at + capacity, side="right"))
        nxt = int(ends[i - 1]) if i else 0
        if nxt <= at:
            return None
        cuts.append(at := nxt)
    return cuts if at >= last else None


def smallest_capacity(ends: np.ndarray, low: int, shards: int) -> int:
    """The smallest capacity >= low at which the greedy fill of the units with these ends succeeds."""
    high = max(int(ends[-1]), low)
    while low < high:
        mid = (low + high) // 2
        if _greedy(ends, mid, shards) is None:
            low = mid + 1
        else:
            high = mid
    return low


def _open_units(ends: np.ndarray, leaf: np.ndarray, low: int, high: int, shards: int) -> np.ndarray:
    """Units that hold several groups and in which a cut may fall for a capacity in [low, high]."""
    starts, todo, a, b = np.concatenate([[0], ends[:-1]]), np.zeros(len(ends), bool), 0, 0
    for _ in range(shards):
        i = int(np.searchsorted(ends, a + low, side="right"))
        a, b = (int(ends[i - 1]) if i else 0), min(b + high, int(ends[-1]))
        todo |= (ends > a) & (starts < b)
    return np.flatnonzero(todo & ~leaf)


def even_cuts(ends: np.ndarray, counts: np.ndarray, leaf: np.ndarray, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """Ends of `shards` shards of at most `capacity`, and the units to be refined for exact cuts.

    ends and counts are sums of sizes and of groups up to each unit's end. A shard ends where it comes nearest
    to an equal share of what is left, but no earlier than lets the rest fit, and keeps a group for each shard to come.
    """
    open_units: set[int] = set()

    def at_least(x: int) -> int:
        """The first unit that ends at x or later."""
        i = int(np.searchsorted(ends, x, side="left"))
        if ends[i] != x and not leaf[i]:
            open_units.add(i)
        return i

    last = len(ends) - 1
    least = [0] * (shards + 1)  # the earliest end of each shard, from which the rest fits
    least[shards] = int(ends[last])
    for s in range(shards - 1, 0, -1):
        x = least[s + 1] - capacity
        least[s] = int(ends[at_least(x)]) if x > 0 else 0
    cuts, at = [], 0
    for s in range(shards):
        if at >= ends[last]:
            break
        left = shards - s
        if left == 1:
            cuts.append(int(ends[last]))
            break
        first = int(np.searchsorted(ends, max(at + 1, least[s + 1]), side="left"))
        if not leaf[first] and least[s + 1] <= at:
            open_units.add(first)
        i = at_least(min(at + capacity, int(ends[last])))
        most = max(first, i if ends[i] <= at + capacity else i - 1)
        done = int(counts[np.searchsorted(ends, at)]) if at else 0
        keep = max(done + 1, int(counts[last]) - (left - 1))  # groups up to here at most
        spare = int(np.searchsorted(counts, keep, side="right")) - 1
        if spare < most and counts[spare] != keep and not leaf[spare + 1]:
            open_units.add(spare + 1)
        most = min(most, max(spare, first))
        want = at + (int(ends[last]) - at) / left
        i = at_least(int(want))
        if i and want - ends[i - 1] < ends[i] - want:
            i -= 1
        at = int(ends[min(max(i, first), most)])
        cuts.append(at)
    return cuts, open_units


def minimax_cuts(groups: DataFrame, shards: int) -> list[int]:
    """Cut positions for groups(bucket, r, b_end, bytes): r from 1 in its bucket, b_end the running sum there."""
    spark = groups.sparkSession
    rows = groups.groupBy("bucket").agg(F.max("b_end").alias("b"), F.max("r").alias("n"), F.max("bytes").alias("m")).orderBy("bucket").collect()
    if not rows:
        return []
    offsets = dict(zip((x.bucket for x in rows), np.concatenate([[0], np.cumsum([x.b for x in rows])[:-1]]).tolist()))
    # unit: (end, bucket, first r, last r)
    units = [(offsets[x.bucket] + x.b, x.bucket, 1, x.n) for x in rows]

    def refine(finer) -> list[tuple]:
        ask = [(units[i][1], units[i][2], units[i][3], -(-(units[i][3] - units[i][2] + 1) // _FINER)) for i in finer]
        wanted = spark.createDataFrame(ask, "bucket int, lo long, hi long, w long")
        got = (
            groups.join(F.broadcast(wanted), "bucket").where("r between lo and hi")
            .groupBy("bucket", "lo", F.floor((F.col("r") - F.col("lo")) / F.col("w")).alias("u"))
            .agg(F.max("b_end").alias("b"), F.min("r").alias("a"), F.max("r").alias("z")).collect()
        )
        gone = set(finer)
        return sorted([u for i, u in enumerate(units) if i not in gone] + [(offsets[x.bucket] + x.b, x.bucket, x.a, x.z) for x in got], key=lambda u: u[:3])

    low = max(-(-units[-1][0] // shards), max(x.m for x in rows))
    while True:
        ends, leaf = np.array([u[0] for u in units], dtype=np.int64), np.array([u[2] == u[3] for u in units])
        capacity = smallest_capacity(ends, low, shards)
        finer = _open_units(ends, leaf, low, capacity, shards).tolist()
        if not finer:
            break
        units = refine(finer)
    while True:
        ends, leaf = np.array([u[0] for u in units], dtype=np.int64), np.array([u[2] == u[3] for u in units])
        counts = np.cumsum([u[3] - u[2] + 1 for u in units])
        cuts, finer = even_cuts(ends, counts, leaf, capacity, shards)
        if not finer:
            return cuts
        units = refine(sorted(finer))


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, sub: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of docs.

    size is the UTF-8 length of the text plus `overhead`; a null text counts as no bytes, and null texts
    form one group of their own, apart from empty ones. Rows with equal id and text are interchangeable
    and take neighbouring slots. The largest shard is as small as contiguous cuts allow, and the others are
    as near to equal shares as that leaves; fewer groups than shards leave the last shards empty; an empty
    table gives no rows. Other columns are ignored. Slots within a group go by (hash of the id, id), so that a
    group holding a third of all rows is ranked by `sub` tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.xxhash64(F.col(text_col)).alias("k1"),
        F.xxhash64(F.lit("second"), F.col(text_col)).alias("k2"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(sub)).cast("int").alias("sub"),
    )
    buckets = min(1 << 18, max(4096, docs.count() >> 12))
    key = Window.partitionBy("k1", "k2")
    parts = (
        base.groupBy("k1", "k2", "sub").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))
        .withColumn("before", F.sum("n").over(key.orderBy("sub").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
        .withColumn("g_n", F.sum("n").over(key)).withColumn("g_bytes", F.sum("bytes").over(key))
        .withColumn("bucket", F.pmod(F.col("k1"), F.lit(buckets)).cast("int"))
    )
    parts = stored(parts.drop("bytes", "n"), "shard-parts")
    order = Window.partitionBy("bucket").orderBy("k1", "k2")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    groups = stored(
        parts.where("before = 0").select(
            "bucket", "k1", "k2", F.col("g_bytes").alias("bytes"),
            F.row_number().over(order).cast("long").alias("r"),
            F.sum("g_bytes").over(upto).alias("b_end"),
            (F.sum("g_n").over(upto) - F.col("g_n")).alias("n_start"),
        ),
        "shard-groups",
    )
    cuts = minimax_cuts(groups, shards)
    # one row for each of at most 2^18 buckets: what lies before it
    one = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.where("before = 0").groupBy("bucket").agg(F.sum("g_bytes").alias("b"), F.sum("g_n").alias("c"))
    sums = sums.select("bucket", F.coalesce(F.sum("b").over(one), F.lit(0)).alias("b0"), F.coalesce(F.sum("c").over(one), F.lit(0)).alias("c0"))
    end = F.col("b_end") + F.col("b0")
    placed = (
        groups.join(F.broadcast(sums), "bucket")
        .select("k1", "k2", total([F.lit(0)] + [(end > c).cast("int") for c in cuts[:-1]]).alias("shard"), (F.col("n_start") + F.col("c0")).alias("g0"))
    )
    placed = stored(placed, "shard-placed")
    first = placed.groupBy("shard").agg(F.min("g0").alias("s0"))  # a row for each shard
    placed = placed.join(F.broadcast(first), "shard").join(parts.select("k1", "k2", "sub", "before"), ["k1", "k2"])
    placed = placed.select("k1", "k2", "sub", "shard", (F.col("g0") - F.col("s0") + F.col("before")).alias("slot0"))
    ranked = base.withColumn("i", F.row_number().over(Window.partitionBy("k1", "k2", "sub").orderBy("doc_id")) - 1)
    return ranked.join(placed, ["k1", "k2", "sub"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("slot0") + F.col("i")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
