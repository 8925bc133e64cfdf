"""Largest-inner-product search by multi-index hashing over learned rotated binary codes.

Codes: vectors, lifted so that largest inner product becomes smallest angle, are centred and projected on
their principal directions, turned by an iteratively learned rotation, and cut at zero to 64 bits. A code
is split into 8 substrings, each with an index from value to rows. Codes within radius r of a query's
agree with it up to floor(r/8) flips in some substring, so probing those values in every index retrieves
every code within r; the floats of these then give the ranking. The radius is learned with the codes.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


BITS, PARTS = 64, 8
_WIDTH = BITS // PARTS
#: XOR masks of a substring, by number of flips.
_FLIPS = [np.array([sum(1 << i for i in c) for c in combinations(range(_WIDTH), k)], np.int64) for k in range(_WIDTH + 1)]


class Codes:
    """Learned codes: lift to unit angle, centre, project, rotate, cut at zero."""

    def __init__(self, sample: np.ndarray, longest: float, rounds: int = 40, seed: int = 7):
        self.longest = longest
        x = self.lift(sample)
        self.mean = x.mean(0)
        x = x - self.mean
        values, vectors = np.linalg.eigh(x.T @ x)
        axes = vectors[:, np.argsort(-values)][:, :BITS]
        rng = np.random.default_rng(seed)
        if axes.shape[1] < BITS:  # fewer dimensions than bits: more directions than axes
            axes = np.hstack([axes, rng.standard_normal((axes.shape[0], BITS - axes.shape[1]))])
        y = x @ axes
        turn = np.linalg.qr(rng.standard_normal((BITS, BITS)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(y @ turn > 0, 1.0, -1.0).T @ y)
            turn = (u @ v).T
        self.turn = axes @ turn

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.longest**2 - (x**2).sum(1), 0))
        return np.hstack([x, rest[:, None]])

    def of(self, lifted: np.ndarray) -> np.ndarray:
        bits = (lifted - self.mean) @ self.turn > 0
        return np.packbits(bits, axis=1).view(np.uint64).ravel()

    def rows(self, x: np.ndarray) -> np.ndarray:
        return self.of(self.lift(x))

    def queries(self, x: np.ndarray) -> np.ndarray:
        scaled = x * (self.longest / np.linalg.norm(x, axis=1))[:, None]
        return self.of(np.hstack([scaled, np.zeros((len(x), 1))]))


def learn(sample: np.ndarray, longest: float, k: int, found: float, probes: int = 400) -> tuple[Codes, int]:
    """Codes and the radius within which a share `found` of the sample's own k nearest rows lie."""
    codes = Codes(sample, longest)
    q = np.arange(0, len(sample), max(1, len(sample) // probes))
    dot = sample[q] @ sample.T
    dot[np.arange(len(q)), q] = -np.inf
    near = np.argsort(-dot, axis=1)[:, : min(k, len(sample) - 1)]
    if not near.size:
        return codes, BITS
    away = np.bitwise_count(codes.queries(sample[q])[:, None] ^ codes.rows(sample)[near])
    return codes, int(np.ceil(np.quantile(away, found)))


class MultiIndex:
    """For each substring of the codes, rows in order of its value and where each value begins."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        subs = codes.view(np.uint8).reshape(-1, PARTS).astype(np.int64)
        order = [np.argsort(subs[:, p], kind="stable") for p in range(PARTS)]
        self.order = np.concatenate(order)
        self.bounds = np.array([p * len(codes) + np.searchsorted(subs[o, p], np.arange((1 << _WIDTH) + 1)) for p, o in enumerate(order)])

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Row numbers of every code within the radius: the values up to radius // PARTS flips away are probed in every index."""
        own = np.array([code], np.uint64).view(np.uint8).astype(np.int64)
        values = own[:, None] ^ np.concatenate(_FLIPS[: min(radius // PARTS, _WIDTH) + 1])[None, :]
        part = np.arange(PARTS)[:, None]
        starts, ends = self.bounds[part, values].ravel(), self.bounds[part, values + 1].ravel()
        n = ends - starts
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        mark = np.zeros(len(self.codes), bool)
        mark[self.order[at]] = True
        at = np.flatnonzero(mark)
        return at[np.bitwise_count(self.codes[at] ^ code) <= radius]


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, found: float = 0.985, sample_rows: int = 20_000, block: int = 8192, query_block: int = 65_536, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by `every`.

    Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
    with a null id; of several dimensions only the commonest (of equals the largest) takes part. A row
    is never a candidate of a query with its own id. Repeated rows are candidates each, but ask once.
    Ties go to the smaller vec_id. The codes are fitted on at most `sample_rows` vectors (by hash of the
    id, then the id); every vector is indexed. A block of about `block` rows has an index, which answers all
    queries (in blocks of `query_block`, as queries are a stated set that meets every row); a block in which
    fewer than k lie within the radius widens it until k are found or all are taken. A block's k best are
    cut to a query's k best by a window that is limited before the shuffle.
    """
    rows = _usable(vectors, id_col, vector_col)
    dims = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return vectors.sparkSession.createDataFrame([], schema)
    d, n, longest = dims[0]["d"], dims[0]["n"], float(np.sqrt(dims[0]["m"]))
    rows = rows.where(F.size("v") == d)
    drawn = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20))
    part = rows.where(drawn < max(1, int((1 << 20) * min(1.0, 1.2 * sample_rows / n)))).orderBy(drawn, "vec_id", "v").limit(sample_rows)
    sample = np.array([r[0] for r in part.select("v").collect()] or [[1.0] * d])
    codes, radius = learn(sample, longest * (1 + 1e-9), k, found)
    sent = vectors.sparkSession.sparkContext.broadcast((codes, radius))
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])
    r_blocks, q_blocks = -(-n // block), max(1, -(-n // every // query_block))
    cell = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    r = rows.withColumn("r", F.pmod(F.xxhash64("vec_id"), F.lit(r_blocks)).cast("int")).withColumn("q", cell(q_blocks))
    q = queries.withColumn("q", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int")).withColumn("r", cell(r_blocks))

    def search(left, right):
        out: list[tuple[np.ndarray, ...]] = []
        if len(left) and len(right):
            codes, radius = sent.value
            x, ids = np.stack(left["v"].to_numpy()), left["vec_id"].to_numpy()
            ask, names = np.stack(right["v"].to_numpy()), right["vec_id"].to_numpy()
            index = MultiIndex(codes.rows(x))
            for v, name, code in zip(ask, names, codes.queries(ask)):
                reach = radius
                while True:
                    at = index.within(code, reach)
                    at = at[ids[at] != name]
                    if len(at) >= k or reach >= BITS:
                        break
                    reach = min(BITS, reach + PARTS)
                score = (x[at] * v).sum(1)
                best = np.lexsort((ids[at], -score))[:k]
                out.append((np.full(len(best), name), ids[at][best], score[best]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pd.DataFrame({"query_id": cols[0], "vec_id": cols[1], "score": cols[2]})

    cells = r.groupBy("r", "q").cogroup(q.groupBy("r", "q")).applyInPandas(search, "query_id long, vec_id long, score double")
    # the k best of a task's rows go into the shuffle, not those of every block
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return cells.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
