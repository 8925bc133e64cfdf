"""Language identification of mixed texts: script gate, word scores, Viterbi with a switching penalty.

A word's script narrows the languages it can be of; scores are naive-Bayes log-likelihoods of its hashed
character n-grams, learned from labelled texts; the best labelling of a text's words pays `penalty` for
each change of language, so that single odd words do not split a span.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, rows_in_chunks

WORD = re.compile(r"[^\W\d_]+")
HASH_BITS = 17
_H = 1 << HASH_BITS
LONGEST_GRAM, FLOOR = 4, -15.0
#: First code points of script ranges, and the script that starts there (0: none of its own).
SCRIPT_STARTS = np.array([0, 0x41, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x900, 0x980, 0xB80, 0xC00, 0xE00, 0x10A0, 0x1100, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3400, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000])
SCRIPTS = np.array([0, 1, 2, 3, 4, 5, 6, 0, 7, 8, 9, 10, 11, 12, 13, 1, 2, 0, 14, 15, 13, 0, 15, 0, 15])
_N_SCRIPTS = 16
UNKNOWN = "und"


def script_of(chars: np.ndarray) -> np.ndarray:
    return SCRIPTS[np.searchsorted(SCRIPT_STARTS, chars, side="right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 1..4-grams of each `^word$`: buckets, the word that each belongs to, and the words' scripts."""
    joined = "".join("^" + w + "$" for w in words)
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    last = np.cumsum(sizes)[owner]  # where the gram's word ends
    out_b, out_w, h = [], [], np.zeros(len(chars), np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        h = h[: len(chars) - n + 1] * np.uint64(1_000_003) + chars[n - 1 :] + np.uint64(n)
        ok = np.flatnonzero(np.arange(len(h)) + n <= last[: len(h)])
        mixed = h[ok] * np.uint64(0x9E3779B97F4A7C15)
        out_b.append((mixed >> np.uint64(64 - HASH_BITS)).astype(np.int64))
        out_w.append(owner[: len(h)][ok])
    firsts = chars[np.cumsum(sizes) - sizes + 1].astype(np.int64)
    return np.concatenate(out_b), np.concatenate(out_w), script_of(firsts)


class Model:
    """Languages, log-likelihood table (bucket, language) and which languages a script can be of."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        c = counts.astype(np.float64) + 0.5
        self.table = np.log(c / c.sum(0)).astype(np.float32)
        share = scripts / np.maximum(scripts.sum(0), 1)
        gate = share >= 0.01
        gate[~gate.any(1)] = True  # a script that no language uses says nothing
        self.closed = np.where(gate, 0.0, np.float32(FLOOR)).astype(np.float32)
        self.blind = ~(share >= 0.01).any(1)
        # likelihood of a language's own n-grams in the mean, and of the next language's: with one language there is none to tell it from
        mean = (counts / np.maximum(counts.sum(0), 1)).T @ self.table.astype(np.float64)  # (text's, model's)
        own = mean.diagonal().copy()
        np.fill_diagonal(mean, -np.inf)
        self.likely = (own + mean.max(0)) / 2 if len(langs) > 1 else own - np.inf

    def score(self, words: list[str]) -> np.ndarray:
        """(word, language): 0 for the word's best language, less for others, FLOOR at least."""
        return self.judge(words)[0]

    def judge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """score; (word, language): if a word's n-grams are nearer to the language's own than to another's; words of blind scripts."""
        b, w, script = grams(words)
        s = np.zeros((len(words), len(self.langs)), np.float32)
        for j in range(len(self.langs)):
            s[:, j] = np.bincount(w, self.table[b, j], len(words))
        likely = s >= np.bincount(w, minlength=len(words))[:, None] * self.likely
        s += 4 * self.closed[script]
        s[self.blind[script]] = 0
        return np.maximum(s - s.max(1, keepdims=True), FLOOR), likely, self.blind[script]


def _pieces(sizes: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and length of the pieces of at most `piece` words that texts of these sizes have, text after text."""
    count = -(-sizes // piece)
    text = np.repeat(np.arange(len(sizes)), count)
    lengths = np.full(len(text), piece, np.int64)
    last = np.cumsum(count)[count > 0] - 1
    lengths[last] = (sizes - (count - 1) * piece)[count > 0]
    return text, lengths


def _steps(lengths: np.ndarray) -> np.ndarray:
    """How many of these lengths, longest first, have a t-th word."""
    return np.searchsorted(-lengths, -np.arange(1, int(lengths[0]) + 1), side="right")


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float, piece: int = 256) -> np.ndarray:
    """Labels of the words of several texts (text after text), each text labelled on its own.

    Texts are cut into pieces that step together, so a long text takes no more steps than a short one. A
    piece is valued for each label before it and each label at its end; these values give the best labels
    at the cuts, and then the best labels between them. A word keeps one byte for each label.
    """
    n = scores.shape[1]
    labels = np.zeros(len(scores), np.int8 if n < 128 else np.int32)
    text, lengths = _pieces(np.asarray(sizes, np.int64), piece)
    if not len(text):
        return labels
    starts = np.cumsum(lengths) - lengths
    opening = np.concatenate([[True], text[1:] != text[:-1]])
    order = np.argsort(-lengths, kind="stable")
    live = _steps(lengths[order])
    ahead = np.where(np.eye(n, dtype=bool), np.float32(0), np.float32(-penalty))  # (label before, label): what a change costs
    before, after = np.full(len(text), -1), np.full(len(text), -1)  # labels at the cuts
    if not opening.all():
        d = np.where(opening[order][:, None, None], np.float32(0), ahead[None]).astype(np.float32)
        for t, a in enumerate(live):
            x = d[:a] if not t else np.maximum(d[:a], d[:a].max(2, keepdims=True) - np.float32(penalty))
            d[:a] = x + scores[starts[order[:a]] + t][:, None, :]
        worth = np.empty_like(d, np.float64)
        worth[order] = d
        place = np.arange(len(text)) - np.flatnonzero(opening)[np.cumsum(opening) - 1]  # a piece's place in its text
        by_place = np.argsort(place, kind="stable")
        bounds = np.searchsorted(place[by_place], np.arange(int(place.max()) + 2))
        best, came = np.zeros((len(text), n)), np.zeros((len(text), n), labels.dtype)
        for k in range(len(bounds) - 1):
            at = by_place[bounds[k] : bounds[k + 1]]
            whole = worth[at] if not k else best[at - 1][:, :, None] + worth[at]
            came[at], best[at] = whole.argmax(1), whole.max(1)
            best[at] -= best[at].max(1, keepdims=True)
        for k in range(len(bounds) - 2, -1, -1):
            at = by_place[bounds[k] : bounds[k + 1]]
            closing = np.append(opening[1:], True)[at]
            after[at] = np.where(closing, best[at].argmax(1), after[at])
            if k:
                before[at] = came[at, after[at]]
                after[at - 1] = before[at]
    back = np.zeros(scores.shape, labels.dtype)
    d = np.where((before[order] < 0)[:, None], np.float32(0), ahead[before[order]]).astype(np.float32)
    every = np.arange(n, dtype=labels.dtype)
    for t, a in enumerate(live):
        x = d[:a]
        if t:
            top = x.max(1, keepdims=True) - np.float32(penalty)
            back[starts[order[:a]] + t] = np.where(x >= top, every, x.argmax(1)[:, None])
            x = np.maximum(x, top)
        x = x + scores[starts[order[:a]] + t]
        d[:a] = x - x.max(1, keepdims=True)
    at = np.where(after[order] < 0, d.argmax(1), after[order])
    for t in range(len(live) - 1, -1, -1):
        a = live[t]
        spot = starts[order[:a]] + t
        labels[spot] = at[:a]
        if t:
            at[:a] = back[spot, at[:a]]
    return labels


class _Numbers(dict):
    """A number for each word, in order of their first coming."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


class Labeller:
    """Labels texts, with a bounded cache of what words score; a text's words are looked up in parts."""

    def __init__(self, model: Model, penalty: float, most: int = 100_000, part: int = 50_000):
        self.model, self.penalty, self.most, self.part = model, penalty, most, part
        self._forget()

    def _forget(self) -> None:
        n = len(self.model.langs)
        self.known = _Numbers()
        self.rows, self.likely = np.empty((0, n), np.float32), np.empty((0, n), bool)
        self.blind, self.letters = np.empty(0, bool), np.empty(0, np.int32)

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """scores, likely, blind and letters of these words."""
        if len(self.known) > self.most:
            self._forget()
        old = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        if new := list(islice(self.known, old, None)):
            score, likely, blind = self.model.judge(new)
            self.rows, self.likely, self.blind = np.vstack([self.rows, score]), np.vstack([self.likely, likely]), np.concatenate([self.blind, blind])
            self.letters = np.concatenate([self.letters, np.fromiter((len(w) if any(map(str.isalpha, w)) else 0 for w in new), np.int32, len(new))])
        return self.rows[at], self.likely[at], self.blind[at], self.letters[at]

    def look_up(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """What _look_up gives for the words of all texts, and the number of words of each text."""
        found, sizes, words = [self._look_up([])], np.zeros(len(texts), np.int64), []
        for i, t in enumerate(texts):
            for m in WORD.finditer(t.lower() if t else ""):
                words.append(m[0])
                sizes[i] += 1
                if len(words) == self.part:
                    found.append(self._look_up(words))
                    words = []
        found.append(self._look_up(words))
        return *(np.concatenate(c) for c in zip(*found)), sizes

    def label(self, per_text: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(labels of all words, number of words of each text)."""
        sizes = np.fromiter(map(len, per_text), np.int64, len(per_text))
        flat = [w for ws in per_text for w in ws]
        parts = [self._look_up(flat[i : i + self.part])[0] for i in range(0, len(flat), self.part)]
        return viterbi(np.concatenate(parts) if parts else self.rows[:0], sizes, self.penalty), sizes

    def summary(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Each text's main language and its share of the letters; UNKNOWN and 0 without letters or languages."""
        n = len(self.model.langs)
        if not n:
            return [(UNKNOWN, 0.0)] * len(texts)
        scores, _, _, letters, sizes = self.look_up(texts)
        labels = viterbi(scores, sizes, self.penalty)
        owner = np.repeat(np.arange(len(texts)), sizes)
        got = np.bincount(owner * n + labels, letters, len(texts) * n).reshape(-1, n)
        top, whole = got.argmax(1), got.sum(1)
        return [(self.model.langs[t], float(g[t] / w)) if w else (UNKNOWN, 0.0) for t, g, w in zip(top, got, whole)]

    def in_known(self, texts: list[str | None], least: float) -> list[bool]:
        """For each text: if a language holds the share `least` of all its letters, and half of these are in words likely in it.

        Letters of a script that no language uses are in the whole, but in no language.
        """
        n = len(self.model.langs)
        if not n:
            return [False] * len(texts)
        scores, likely, blind, letters, sizes = self.look_up(texts)
        labels = viterbi(scores, sizes, self.penalty)
        owner = np.repeat(np.arange(len(texts)), sizes)
        count = lambda x: np.bincount(owner * n + labels, x, len(texts) * n).reshape(-1, n)
        got, sure = count(letters * ~blind), count(letters * (likely[np.arange(len(labels)), labels] & ~blind))
        top, whole = got.argmax(1), np.bincount(owner, letters, len(texts))
        row = np.arange(len(texts))
        return ((whole > 0) & (got[row, top] >= least * whole) & (2 * sure[row, top] >= got[row, top]) & (got[row, top] > 0)).tolist()


def fit(docs: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from the rows of docs with text and language, at most about `most_rows` of them by hash of id and text.

    Where rows repeat so much that this takes far too many or too few, each different row counts once. Counts are summed by Spark; the driver gets one table of hashed counts. No usable row: no language.
    """
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.lit(11), F.col(id_col).cast("string"), F.col(text_col)).alias("h"))

    def part(of: DataFrame, n: int) -> DataFrame:
        return of if n <= most_rows else of.where(F.pmod("h", F.lit(1 << 20)) < max(1, int((1 << 20) * most_rows / n)))

    n = rows.select("lang").count()
    drawn = part(rows, n)
    if n > most_rows and not most_rows // 4 <= drawn.select("h").count() <= 4 * most_rows:
        rows = rows.dropDuplicates(["h"])
        drawn = part(rows, rows.select("h").count())
    rows = drawn

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for c in rows_in_chunks(batches, "text"):
            by: dict[str, list[str]] = {}
            for t, lang in zip(c["text"], c["lang"]):
                by.setdefault(lang, []).extend(WORD.findall(t.lower()))
            for lang, words in by.items():
                have = sums.setdefault(lang, np.zeros(_H + _N_SCRIPTS, np.int64))
                for i in range(0, len(words), 100_000):
                    b, _, script = grams(words[i : i + 100_000])
                    have[:_H] += np.bincount(b, minlength=_H)
                    have[_H:] += np.bincount(script, minlength=_N_SCRIPTS)
        for lang, have in sums.items():
            at = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(have[at], pa.int64())], ["lang", "b", "n"])

    got = rows.select("text", "lang").mapInArrow(frugal(count), "lang string, b long, n long").groupBy("lang", "b").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((_H + _N_SCRIPTS, len(langs)), np.int64)
    if langs:
        of = {x: j for j, x in enumerate(langs)}
        counts[got.column("b").to_numpy(), [of[x] for x in got.column("lang").to_pylist()]] = got.column("n").to_numpy()
    return Model(langs, counts[:_H], counts[_H:])


def predict(docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (and the columns in keep) for every row of docs.

    lang_pred is the language of most letters, score their share. A null, empty or letterless text is
    `und` with score 0, as is any text if no language was learned. Equal shares go to the language first
    in the alphabet. Repeated rows get a row each; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lab = Labeller(sent.value, penalty)
        for c in rows_in_chunks(batches, "text", 2_000_000):
            got = lab.summary(c["text"])
            yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, lang_pred string, score double")


def spans(docs: DataFrame, model: Model, penalty: float = 12.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, end (characters), lang: the runs of words of one language, in order; none without letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        lab = Labeller(sent.value, penalty)
        for c in rows_in_chunks(batches, "text", 2_000_000):
            found = [[m for m in WORD.finditer(t)] if t and lab.model.langs else [] for t in c["text"]]
            labels, sizes = lab.label([[m[0].lower() for m in ms] for ms in found])
            out, at = [], 0
            for d, ms in zip(c["doc_id"], found):
                for m, j in zip(ms, labels[at : at + len(ms)].tolist()):
                    if out and out[-1][0] == (d, at) and out[-1][3] == j:
                        out[-1][2] = m.end()
                    else:
                        out.append([(d, at), m.start(), m.end(), j])
                at += len(ms)
            yield pa.RecordBatch.from_arrays([pa.array([o[0][0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([lab.model.langs[o[3]] for o in out], pa.string())], ["doc_id", "start", "end", "lang"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, start long, end long, lang string")


def in_known_language(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs whose main language was learned and holds at least the share `least` of their letters.

    Letters of a script that was not learned count as of no language, and a text is of a language only if half
    of its letters there are in words whose n-grams are nearer to that language's than to the next one's. Where
    only one language was learned, scripts alone decide.
    """
    sent, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns
    at = names.index("text")

    def run(batches):
        lab = Labeller(sent.value, 12.0)
        for b in batches:
            texts, keep = b.column(at).to_pylist(), []
            start = 0
            while start < len(texts):
                end, size = start, 0
                while end < len(texts) and (end == start or size < 2_000_000):
                    size += len(texts[end] or "")
                    end += 1
                keep += lab.in_known(texts[start:end], least)
                start = end
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(frugal(run), docs.schema)
