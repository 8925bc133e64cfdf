"""Embedding whitening by matrix-free block subspace iteration.

Vectors are put on an integer grid, floor(64 c), so that their count and sums are exact. A pass over the
rows gives Y = Z'(ZQ) of the centred rows Z and an orthonormal block Q: each task multiplies its batches
and emits one matrix as wide as the block, so neither the rows nor their covariance are ever gathered.
On the driver Rayleigh-Ritz turns Q and Y into eigenvectors with residuals, which the same Y certifies;
otherwise QR of Y is the next block. A block that converges slowly (close eigenvalues) is doubled; one
as wide as the vectors ends in one pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, SHIFT = 64, 1_000_000
#: Entries of the grid beyond this are not exact in the sums.
LARGEST = 2**46
_SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """n rows with grid sums S, eigenvectors (columns) and eigenvalues of their covariance, its trace, the passes taken."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residual: float
    passes: int

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.sums)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (self.centred(x) @ self.vectors) / np.sqrt(self.values)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (doubles) of the rows whose vector is neither null nor empty nor holds null or non-finite entries."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(v.isNotNull() & (F.size(v) > 0) & ~bad).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"))


def commonest_dimension(rows: DataFrame) -> tuple[int, int]:
    """The commonest size of v (of equals the largest) and its number of rows; 0, 0 for no rows."""
    top = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return (top[0]["d"], top[0]["count"]) if top else (0, 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def grid(v: np.ndarray) -> np.ndarray:
    """floor(64 v) as long; the shift of the contract cancels wherever a mean is taken off."""
    x = np.floor(GRID * v)
    if x.size and np.abs(x).max() > LARGEST:
        raise ValueError(f"a vector has an entry beyond {LARGEST // GRID}")
    return x.astype(np.int64)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n from the exact n x - S; where that is beyond long, from the difference to the whole part of the mean."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 2**62:
        return (n * x - sums) / n
    whole = sums // n
    return (x - whole) - (sums - whole * n) / n


def _added(rows: DataFrame, task: Callable[[Iterator[np.ndarray]], np.ndarray], d: int, dtype: type) -> np.ndarray:
    """The sum over all tasks of task(batches of vectors), arrays of one length: added in groups of tasks, then on the driver."""

    def part(batches):
        out = task(_matrix(b.column(0), d) for b in batches if b.num_rows)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    def add(batches):
        out = None
        for b in batches:
            for s in b.column(0):
                a = np.frombuffer(s.as_py(), dtype)
                out = a.copy() if out is None else out + a
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["sums"])

    parts = rows.select("v").mapInArrow(part, "sums binary")
    tasks = parts.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(add, "sums binary")
    return sum(np.frombuffer(r[0], dtype) for r in parts.collect())


def _totals(rows: DataFrame, d: int) -> np.ndarray:
    """Exact sums of the grid by dimension."""

    def task(batches):
        out = None
        for v in batches:
            s = grid(v).sum(0)
            out = s if out is None else out + s
        return out

    return _added(rows, task, d, np.int64)


def _product(rows: DataFrame, n: int, sums: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Z'(ZQ)/n and the trace of Z'Z/n of all centred rows."""
    d, p = q.shape
    sent = rows.sparkSession.sparkContext.broadcast((n, sums, q))

    def task(batches):
        n, sums, q = sent.value
        out = None
        for v in batches:
            z = _centred(grid(v), n, sums)
            a = np.append((z.T @ (z @ q)).ravel(), (z * z).sum())
            out = a if out is None else out + a
        return out

    got = _added(rows, task, d, np.float64)
    sent.unpersist()
    return got[:-1].reshape(d, p) / n, float(got[-1]) / n


def fit(rows: DataFrame, d: int, n: int, k: int, tolerance: float = 1e-12, most_passes: int = 500, seed: int = 11) -> Whitening:
    """The k leading eigenvectors of the grid's covariance over `rows` (vec_id, v; all of dimension d, n of them).

    Ends when every one of the k residuals is at most `tolerance` of the largest eigenvalue, and raises if
    `most_passes` passes do not suffice. Directions whose eigenvalue is zero but for rounding are left out.
    """
    sums = _totals(rows, d)
    rng = np.random.default_rng(seed)
    width, before = min(d, 2 * k), math.inf
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    for passes in range(1, most_passes + 1):
        y, trace = _product(rows, n, sums, q)
        t = q.T @ y
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        u, vu = q @ turn, y @ turn
        away = np.linalg.norm(vu - u * values, axis=0)
        wanted = min(k, int((values > 1e-12 * max(values[0], 0)).sum()))
        worst = float(away[:wanted].max(initial=0)) / values[0] if wanted else 0.0
        if worst <= tolerance and (width == d or passes > 1):
            lead = u[:, :wanted]
            sign = np.sign(lead[np.abs(lead).argmax(0), np.arange(wanted)])
            return Whitening(n, sums, lead * sign, values[:wanted].copy(), trace, worst, passes)
        left = math.log(worst / tolerance) / math.log(before / worst) if tolerance < worst < before else math.inf
        if width < d and left > 12 and passes > 1:
            width = min(d, 2 * width)
        before = worst
        q = np.linalg.qr(np.hstack([vu, rng.standard_normal((d, width - vu.shape[1]))]))[0]
    raise RuntimeError(f"residuals are at {worst} of the largest eigenvalue after {most_passes} passes")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity; their mean is zero, as the rows' is taken off."""
    k = len(model.values)
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        out = None
        for v in batches:
            w = sent.value.apply(grid(v))
            a = (w.T @ w).ravel()
            out = a if out is None else out + a
        return out

    return float(np.abs(_added(rows, task, len(model.sums), np.float64).reshape(k, k) / model.n - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: np.ndarray) -> pa.Array:
    """Sums of squares of n x - S, exact; null beyond a long."""
    reach = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if x.shape[1] * reach**2 < 2**63:
        return pa.array(((n * x - sums) ** 2).sum(1), pa.int64())
    away = n * x.astype(object) - sums.astype(object)
    return pa.array([s if s < 2**63 else None for s in (away * away).sum(1)], pa.int64())


def whiten(vectors: DataFrame, k: int = 32, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error: k rows a vector, fitted on all vectors.

    Rows whose vector is null, empty or holds null or non-finite entries are left out, as are those of
    another dimension than the commonest (of equals the largest). Repeated rows count and return each;
    null ids stay null. Fewer components come back where the covariance has a lower rank: none for equal
    vectors, no row at all for an empty table. A sum of squares beyond a long is null; an entry beyond
    2^40 raises. Other columns are not looked at. A component's sign makes its largest entry positive.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    d, n = commonest_dimension(rows)
    if not n:
        return spark.createDataFrame([], _SCHEMA)
    rows = rows.where(F.size("v") == d)
    model = fit(rows, d, n, k)
    if not len(model.values):
        return spark.createDataFrame([], _SCHEMA)
    sent = spark.sparkContext.broadcast((model, identity_error(rows, model)))

    def out(batches):
        model, error = sent.value
        k = len(model.values)
        for b in batches:
            x = grid(_matrix(b.column(1), d))
            each = np.repeat(np.arange(len(x)), k)
            size = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(size, model.n, np.int64)),
                    _deviations(x, model.n, model.sums).take(pa.array(each)),
                    pa.array(model.apply(x).ravel()),
                    pa.array(np.tile(model.explained, len(x))),
                    pa.array(np.full(size, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(out, _SCHEMA)
