"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by its nearest reference points (pivots) in order. Vectors that share at least
`shared` of their `nearest` pivots are candidates: they meet in the inverted list of their first common
pivots, where shared pivots are counted; the cosine of the vectors then decides. A list is named by one pivot, or by
several where lists of one would be long; each pair is looked at in one list only, and which pairs are
found does not depend on that choice. Lists beyond `block` members are dealt into pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored
from .graph import components
from .whitening import commonest_dimension, usable

#: A list's name holds up to 3 pivot numbers of so many bits.
_BITS = 16
#: Lists are named by one pivot more where their expected length is beyond this.
_LONG = 8192


class Pivots:
    """Reference points, each the sample's farthest from those before; numbered from the rarest in the sample's lists to the commonest."""

    def __init__(self, sample: np.ndarray, most: int, nearest: int):
        unit = sample / np.linalg.norm(sample, axis=1)[:, None]
        at, close = [0], unit @ unit[0]
        while len(at) < min(most, len(unit)):
            far = int(close.argmin())
            if close[far] > 1 - 1e-9:
                break
            at.append(far)
            close = np.maximum(close, unit @ unit[far])
        self.points, self.nearest = unit[at], min(nearest, len(at))
        uses = np.bincount(self.permutation(unit).ravel(), minlength=len(at))
        self.points = self.points[np.argsort(uses, kind="stable")]

    def permutation(self, unit: np.ndarray) -> np.ndarray:
        """Numbers of the nearest pivots of each row, nearest first."""
        out = []
        for k in range(0, len(unit), 4096):
            near = unit[k : k + 4096] @ self.points.T
            top = np.argpartition(-near, self.nearest - 1, axis=1)[:, : self.nearest]
            out.append(np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1))
        return np.concatenate(out) if out else np.empty((0, self.nearest), np.int64)


def list_names(codes: np.ndarray, shared: int, named: int) -> np.ndarray:
    """For each row of ascending pivot numbers, the names of its lists: every choice of `named` pivots that `shared` common ones can begin with."""
    width = codes.shape[1] - shared + named
    picks = np.array(list(combinations(range(width), named)))
    name = np.zeros((len(codes), len(picks)), np.int64)
    for j in range(named):
        name = name << _BITS | codes[:, picks[:, j]]
    return name


def links_of_list(name: int, named: int, shared: int, codes: np.ndarray, unit: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a list that share enough pivots, the list's own first, and whose cosine is at least `least`.

    Inverted lists over the rows' pivots count what pairs share; a common pivot in front of the name's
    last one means that another list has the pair. With `side`, only pairs of both sides count.
    """
    b = len(codes)
    own = {name >> _BITS * j & (1 << _BITS) - 1 for j in range(named)}
    last = max(own)
    order = np.argsort(codes.ravel(), kind="stable")
    pivots, starts = np.unique(codes.ravel()[order], return_index=True)
    counts = np.full((b, b), named, np.int8)
    for p, rows in zip(pivots.tolist(), np.split(order // codes.shape[1], starts[1:])):
        if p in own or len(rows) < 2:
            continue
        at = np.ix_(rows, rows)
        if p < last:
            counts[at] = -100
        else:
            counts[at] += 1
    ready = counts >= shared
    if side is None:
        ready &= np.tri(b, k=-1, dtype=bool).T
    else:
        ready[side, :] = False
        ready[:, ~side] = False
    if ready.sum() > b * b // 16:
        i, j = np.nonzero(ready & (unit @ unit.T >= least))
        return i, j
    i, j = np.nonzero(ready)
    if not len(i):
        return i, j
    close = np.concatenate([(unit[i[k : k + 50_000]] * unit[j[k : k + 50_000]]).sum(1) for k in range(0, len(i), 50_000)]) >= least
    return i[close], j[close]


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row that it reaches over the pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], pa.Table]]:
    """Runs of equal (name, a, b) in sorted batches."""
    now, held = None, []
    for batch in batches:
        keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(keys)]):
            if lo == hi:
                continue
            key = tuple(keys[lo].tolist())
            if key != now and held:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)


def near_links(classes: DataFrame, d: int, least: float, pivots: int, nearest: int, shared: int, sample_rows: int, block: int, named: int | None = None, wire: type = np.float64) -> DataFrame:
    """cid, n, root: for each class (cid, copies, v) and list with a link of it, the linked copies and one class that it reaches."""
    spark = classes.sparkSession
    total = classes.count()
    drawn = F.pmod(F.xxhash64("v"), F.lit(1 << 20))
    part = classes.where(drawn < max(1, int((1 << 20) * min(1.0, 1.2 * sample_rows / max(1, total))))).orderBy(drawn, "v").limit(sample_rows)
    sample = np.array([r[0] for r in part.select("v").collect()] or [[1.0] * d])
    index = Pivots(sample, pivots, nearest)
    nearest = index.nearest
    shared = max(1, min(shared, nearest - 1))
    if named is None:
        named = next((k for k in range(1, min(shared, 3)) if total * comb(nearest - shared + k, k) / comb(len(index.points), k) <= _LONG), min(shared, 3))
    sent = spark.sparkContext.broadcast(index)

    def describe(batches):
        index = sent.value
        for b in batches:
            v = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            codes = np.sort(index.permutation(v / np.linalg.norm(v, axis=1)[:, None]), axis=1)
            names = list_names(codes, shared, named)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, names.size + 1, names.shape[1], dtype=np.int32)), pa.array(names.ravel()))
            small = codes.astype(np.uint16)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tobytes() for c in small], pa.binary()), pa.array([x.tobytes() for x in v.astype(wire)], pa.binary()), lists], ["cid", "copies", "code", "v", "names"])

    described = stored(classes.select("cid", "copies", "v").mapInArrow(describe, "cid long, copies long, code binary, v binary, names array<long>"), "pivot-codes")
    sizes = described.select(F.explode("names").alias("name")).groupBy("name").count()
    crowded = stored(sizes.where(F.col("count") > block).select("name", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "pivot-crowded")
    entries = described.select(F.explode("names").alias("name"), "cid", "copies", "code", "v").join(crowded, "name", "left")
    own = F.pmod(F.xxhash64("cid"), F.coalesce("blocks", F.lit(1))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))
    cells = entries.withColumn("own", own).withColumn("other", other)
    cells = cells.select("name", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "cid", "copies", "code", "v")

    def search(batches):
        for (name, a, b), rows in _lists(batches):
            if len(rows) < 2:
                continue
            ids, copies = rows.column("cid").to_numpy(), rows.column("copies").to_numpy()
            codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint16).reshape(len(ids), -1)
            v = np.frombuffer(b"".join(rows.column("v").to_pylist()), wire).astype(np.float64).reshape(len(ids), d)
            side = None if a == b else rows.column("own").to_numpy() == b
            i, j = links_of_list(name, named, shared, codes, v / np.linalg.norm(v, axis=1)[:, None], side, least)
            if not len(i):
                continue
            n = np.zeros(len(ids), np.int64)
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            linked = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(n[linked]), pa.array(ids[_roots(len(ids), i, j)[linked]])], ["cid", "n", "root"])

    dealt = cells.repartition("name", "a", "b").sortWithinPartitions("name", "a", "b")
    return dealt.mapInArrow(frugal(search), "cid long, n long, root long")


def near_duplicates(vectors: DataFrame, least: float = 0.9, pivots: int = 1024, nearest: int = 12, shared: int = 3, sample_rows: int = 10_000, block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding", named: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a row, linked where the cosine of two rows found is at least `least`.

    Null, empty and zero vectors, and those with null or non-finite components, link with nothing, nor do
    those of another dimension than the commonest (of equals the largest). Equal vectors are one class that
    is compared once and counts with its rows; repeated rows count each. A null id links as any other; it is no
    component's name unless no row has an id, and is not kept. An empty table gives no rows; other
    columns are not looked at. Pivots come from at most `sample_rows` vectors (by hash); every vector is indexed.
    """
    if not 1 <= shared < nearest or pivots >= 1 << _BITS:
        raise ValueError("shared must be below nearest, and pivots below 65,536")
    v = F.col(vector_col)
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    rows = usable(vectors, id_col, vector_col)
    d, _ = commonest_dimension(rows.where(F.exists("v", lambda x: x != 0)))
    takes_part = v.isNotNull() & (F.size(v) == d) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    takes_part = F.coalesce(takes_part, F.lit(False))
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(takes_part, v.cast("array<double>")).alias("v"))
    alone = every.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    rows = every.where("v is not null")
    classes = rows.groupBy("v").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "pivot-classes")
    found = stored(near_links(classes, d, least, pivots, nearest, shared, sample_rows, block, named, np.float32 if single else np.float64), "pivot-links")
    sums = stored(found.groupBy("cid").agg(F.sum("n").alias("n")), "pivot-sums")
    roots = stored(components(found.select("cid", "root"), "cid", "root").select(F.col("node").alias("cid"), "root"), "pivot-roots")
    marked = classes.select("cid", "v", "copies", "first").join(sums, "cid", "left").join(roots, "cid", "left")
    marked = stored(marked.select("v", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "cid").alias("root")), "pivot-marked")
    names = stored(marked.groupBy("root").agg(F.min("first").alias("component_id")), "pivot-names")
    marked = stored(marked.join(names, "root").select("v", "n_links", "component_id"), "pivot-named")
    linked = rows.join(marked, "v").select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
