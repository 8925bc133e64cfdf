"""Toxicity scores by a convolutional text classifier, trained in numpy.

Words are hashed to embeddings; filters of several widths slide over the whole text, the largest response
of each is kept, and a logistic layer reads them. Thresholds are set for each guessed language on rows kept
back from training, and scores are bent so that 0.5 is the threshold. Languages are guessed by clusters of
the training texts' commonest words, which are mostly function words; no label of language is read.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, rows_in_chunks, stored

WORD = re.compile(r"[^\W\d_]+")
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 15, 12, (1, 2, 3), 8
_PAD = max(WIDTHS) - 1
#: The commonest words by which languages are told apart, and clusters of texts at most.
MARKS, CLUSTERS = 256, 8


class Words:
    """Bucket ids of words and guesses of language, with a bounded cache."""

    def __init__(self, most: int = 400_000):
        self.most, self.known = most, {}

    def ids(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
        known = self.known
        if len(known) > self.most:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = 1 + zlib.crc32(w.encode("utf-8", "surrogatepass")) % BUCKETS
        return np.fromiter(map(known.__getitem__, words), np.int32, len(words))


class Tongues:
    """Clusters of texts by shares of the commonest words, learned without labels."""

    def __init__(self, docs: list[np.ndarray], rounds: int = 25):
        seen = np.zeros(BUCKETS + 1, np.int64)
        for d in docs:
            seen[np.unique(d)] += 1
        marks = np.lexsort((np.arange(BUCKETS + 1), -seen))[:MARKS]
        marks = marks[seen[marks] > 0]
        self.column = np.zeros(BUCKETS + 1, np.int16)
        self.column[marks] = np.arange(1, len(marks) + 1)
        self.centres = np.empty((0, len(marks)))
        x = np.array([v for d in docs if (v := self.shares(d)).any()])
        if not len(x):
            return
        picked = [0]  # each next one is the text least like those before
        while len(picked) < min(CLUSTERS, len(x)):
            near = (x @ x[picked].T).max(1)
            if near.min() > 0.999:
                break
            picked.append(int(near.argmin()))
        centres = x[picked]
        for _ in range(rounds):
            own = (x @ centres.T).argmax(1)
            means = np.array([x[own == k].mean(0) if (own == k).any() else centres[k] for k in range(len(centres))])
            centres = means / np.linalg.norm(means, axis=1, keepdims=True)
        self.centres = centres

    def shares(self, ids: np.ndarray) -> np.ndarray:
        """Roots of the marks' shares in a text, of length one, or zeros."""
        n = np.bincount(self.column[ids], minlength=self.centres.shape[1] + 1)[1:].astype(np.float64)
        return np.sqrt(n / max(1.0, n.sum()))

    def guess(self, ids: np.ndarray) -> int:
        """The nearest cluster's number, -1 if the text has none of the marks."""
        v = self.shares(ids)
        return int((self.centres @ v).argmax()) if len(self.centres) and v.any() else -1


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All ids with blank ids between texts, and where each text starts; every text has a position at least."""
    gap = np.zeros(_PAD, np.int32)
    parts = []
    for d in docs:
        parts += [d if len(d) else gap[:1], gap]
    sizes = np.array([max(1, len(d)) + _PAD for d in docs])
    return np.concatenate(parts), np.cumsum(sizes) - sizes


class Net:
    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.E = (rng.standard_normal((BUCKETS + 1, DIM)) * 0.1).astype(np.float32)
        self.E[0] = 0
        self.W = [(rng.standard_normal((w * DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS]
        self.b = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = (rng.standard_normal(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.thresholds: dict[int, float] = {}
        self.tongues = Tongues([])

    def pooled(self, ids: np.ndarray, starts: np.ndarray, where: bool = False):
        """Largest response of every filter in each text (and its position)."""
        x = self.E[ids]
        feats, at = [], []
        for w, W, b in zip(WIDTHS, self.W, self.b):
            n = len(ids)
            r = x @ W[:DIM] + b
            for k in range(1, w):
                r[: n - k] += x[k:] @ W[k * DIM : (k + 1) * DIM]
                r[np.append(starts[1:], n) - k] = -np.inf  # would reach into the next text
            top = np.maximum.reduceat(r, starts, axis=0)
            if where:
                ends = np.append(starts[1:], n)
                at.append(np.stack([s + r[s:e].argmax(0) for s, e in zip(starts, ends)]))
            feats.append(top)
        return np.maximum(np.hstack(feats), 0), at

    def raw(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.empty(0)
        f, _ = self.pooled(*_joined(docs))
        return 1 / (1 + np.exp(-np.clip(f @ self.out + self.bias, -30, 30)))

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        p = self.raw(docs)
        t = np.array([self.thresholds.get(self.tongues.guess(d), self.thresholds.get(-1, 0.5)) for d in docs])
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t)) if len(p) else p

    def train(self, docs: list[np.ndarray], y: np.ndarray, epochs: int, rate: float = 0.05, batch: int = 16, seed: int = 5) -> None:
        """Adagrad on the log-loss. Embeddings' first dimension starts as the bucket's log-odds by documents."""
        seen = np.zeros((2, BUCKETS + 1))
        for d, t in zip(docs, y):
            seen[int(t), np.unique(d)] += 1
        n = np.bincount(y.astype(int), minlength=2)
        odds = np.log((seen[1] + 1.5) / (n[1] + 3)) - np.log((seen[0] + 1.5) / (n[0] + 3))
        self.E[:, 0] = np.clip(odds, -2, 4) * np.minimum(1, seen.sum(0) / 8)
        for W in self.W:
            W[0 : FILTERS * DIM : DIM, : FILTERS // 2] = np.abs(W[0 : FILTERS * DIM : DIM, : FILTERS // 2]) + 0.3
        self.E[0] = 0
        rng = np.random.default_rng(seed)
        g2 = {"E": np.full_like(self.E, 1e-2), "out": np.full_like(self.out, 1e-2), "bias": np.full(1, 1e-2), "W": [np.full_like(w, 1e-2) for w in self.W], "b": [np.full_like(x, 1e-2) for x in self.b]}
        weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                ids, starts = _joined([docs[j] for j in at])
                f, where = self.pooled(ids, starts, True)
                p = 1 / (1 + np.exp(-np.clip(f @ self.out + self.bias, -30, 30)))
                err = ((p - y[at]) * weight[at] / len(at)).astype(np.float32)
                df = err[:, None] * self.out[None] * (f > 0)
                step = lambda v, s, g: (s.__iadd__(g * g), v.__isub__(rate * g / np.sqrt(s)))
                for k, w in enumerate(WIDTHS):
                    d = df[:, k * FILTERS : (k + 1) * FILTERS]
                    pos = where[k]
                    gW, gE_i, gE_v = np.zeros_like(self.W[k]), [], []
                    for o in range(w):
                        word = ids[np.minimum(pos + o, len(ids) - 1)]  # (text, filter)
                        gW[o * DIM : (o + 1) * DIM] = np.einsum("tf,tfd->df", d, self.E[word])
                        gE_i.append(word.ravel())
                        gE_v.append((d[:, :, None] * self.W[k][o * DIM : (o + 1) * DIM].T[None]).reshape(-1, DIM))
                    idx, inv = np.unique(np.concatenate(gE_i), return_inverse=True)
                    gE = np.zeros((len(idx), DIM), np.float32)
                    np.add.at(gE, inv, np.concatenate(gE_v))
                    gE[idx == 0] = 0
                    g2["E"][idx] += gE * gE
                    self.E[idx] -= rate * gE / np.sqrt(g2["E"][idx])
                    step(self.W[k], g2["W"][k], gW)
                    step(self.b[k], g2["b"][k], d.sum(0))
                step(self.out, g2["out"], f.T @ err)
                step(self.bias, g2["bias"], np.array([err.sum()]))

    def calibrate(self, docs: list[np.ndarray], y: np.ndarray, least: int = 12) -> None:
        """The threshold of best F1 for each guessed language with `least` rows of both kinds; -1 holds for the rest."""
        p = self.raw(docs)
        langs = np.array([self.tongues.guess(d) for d in docs])
        for g in (-1, *range(len(self.tongues.centres))):
            at = np.arange(len(p)) if g == -1 else np.flatnonzero(langs == g)
            pos = int(y[at].sum())
            if min(pos, len(at) - pos) < (1 if g == -1 else least):
                continue
            order = at[np.argsort(-p[at], kind="stable")]
            hits = np.cumsum(y[order])
            f1 = 2 * hits / (np.arange(1, len(order) + 1) + pos)
            k = int(f1.argmax())
            low = p[order[k + 1]] if k + 1 < len(order) else 0.0
            self.thresholds[g] = float(np.clip((p[order[k]] + low) / 2, 0.02, 0.98))


def fit(docs: DataFrame, labels: DataFrame, most_of_each: int = 2500, most_chars: int = 100_000_000, epochs: int = 4, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Net:
    """A classifier from at most `most_of_each` labelled rows of either kind, first by hash of the id.

    These have `most_chars` characters together at most: in that order, a whole text that would go beyond is
    left out. Labels that are null or of rows not in docs are left out; of several labels of an id the
    largest holds, of several texts the first in order. Every fifth row is kept back to set thresholds. Without rows of both kinds the untrained net
    answers with the share of ones, if any.
    """
    wanted = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("y"))
    order = [F.xxhash64(F.lit(17), F.col("id")), F.col("id")]
    wanted = wanted.where("y = 1").orderBy(*order).limit(most_of_each).unionByName(wanted.where("y = 0").orderBy(*order).limit(most_of_each))

    def run(batches):
        words = Words()
        for c in rows_in_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array(c["id"], pa.int64()), pa.array(c["y"], pa.int32()), pa.array([words.ids(t) for t in c["text"]], pa.list_(pa.int32()))], ["id", "y", "w"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(wanted), "id")
    rows = stored(rows.groupBy("id").agg(F.max("y").alias("y"), F.min("text").alias("text")), "training-rows")
    taken, size = [], 0
    for r in rows.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(*order).collect():  # twice most_of_each at most
        if size + r.n <= most_chars:
            taken.append((r.id,))
            size += r.n
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "id long")), "id").select("id", "y", "text")
    got = rows.mapInArrow(frugal(run), "id long, y int, w array<int>").toArrow()
    ids = [np.asarray(x, np.int32) for x in got.column("w").to_pylist()] if got.num_rows < 1 else [x.values.to_numpy() if x.values is not None else np.empty(0, np.int32) for x in got.column("w")]
    order = np.lexsort((got.column("id").to_numpy(), [zlib.crc32(str(i).encode()) for i in got.column("id").to_pylist()])) if got.num_rows else []
    y = got.column("y").to_numpy()
    ids, y = [ids[i] for i in order], np.array([y[i] for i in order], np.float64)
    net = Net()
    if len(y) and 0 < y.sum() < len(y):
        back = np.arange(len(y)) % 5 == 4
        if not 0 < y[back].sum() < back.sum():
            back = np.zeros(len(y), bool)
        net.tongues = Tongues(ids)
        net.train([d for d, b in zip(ids, back) if not b], y[~back], epochs * (1 + 1500 // len(y)))
        held = back if back.any() else ~back
        net.calibrate([d for d, b in zip(ids, held) if b], y[held])
    else:
        net.out[:] = 0
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.01
        net.bias[:] = np.log(share / (1 - share))
    return net


def predict(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row of docs; null and empty texts score like a text without words.

    Whole texts are scored. Repeated rows get a row each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        net, words = sent.value, Words()
        for c in rows_in_chunks(batches, "text", 1_000_000):
            s = net.scores([words.ids(t) for t in c["text"]])
            yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, score double, predicted int")
