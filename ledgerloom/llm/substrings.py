"""Removal of passages that repeat across documents, by prefix-partitioned suffix trees.

A suffix is a document's text from one word on, cut at depth `window` (50 words). Suffixes are partitioned
by prefixes of variable length, so that a group fits in memory, and each group's suffix tree is built in
one task: its suffixes are sorted by prefix doubling over word numbers, and neighbours in that order that
share `window` words hang below one internal node of that depth. The smallest document below a node owns
the passage; in all others the suffix is a repeat.

1. The first cut is by the *minimizer*: of the grams of `gram` words in a suffix the one with the smallest
   hash. Equal suffixes have equal minimizers, and neighbouring suffixes mostly share one: they travel as
   a run of at most `window` suffixes. Every run sends only (minimizer, run hash, id), combined before the
   shuffle. A minimizer that one document alone has is a leaf, and is dropped: most are.
2. The texts are read again; runs of the minimizers left (known by a bitmap of fixed size: a false hit
   costs time, not truth) are kept, with their words where several different runs share the minimizer.
   Copies of a run (equal by 192 bits of hashes) are one leaf with their smallest document.
3. A minimizer whose different runs have more than `group_words` words is cut further: prefixes of 16, then
   32 words part its single suffixes until a group fits, and prefixes of one document are dropped. What is
   still too large at full depth is a node by itself, and needs only a smallest document.
4. Each group's tree is built from the words of its runs; its nodes' words are compared, not hashes.

So a passage that a third of all documents share is one leaf where its surroundings are shared too, and
elsewhere its suffixes are parted by depth: no step collects a group of unbounded size in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, rows_in_chunks, spare, stored, words_spaced

_ODD = np.uint64(0x9E3779B97F4A7C15)
#: log2 of the bits in a bitmap of minimizers.
BITMAP_BITS = 26
#: Words of a group of suffixes that one tree is built from, words that a task takes in at once, and words a task is dealt.
GROUP_WORDS, AT_ONCE, TASK_WORDS = 500_000, 200_000, 2_000_000
#: Prefix lengths, in shares of the window, by which the suffixes of a crowded minimizer are parted.
DEPTHS = (0.32, 0.64)
_RUN = ["key", "sig", "check"]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _runs_hash(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` neighbours, by doubling."""
    power, have, width, out, done = _ODD, h, 1, None, 0
    while True:
        if size & width:
            out = have[: len(h) - size + 1].copy() if out is None else out * power + have[done : done + len(h) - size + 1]
            done += width
        if width * 2 > size:
            return _mix(out)
        have = _mix(have[:-width] * power + have[width:])
        width, power = width * 2, np.uint64((int(power) * int(power) + 2) & (1 << 64) - 1)


def _smallest(g: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every run of `size` neighbours."""
    m, width = g, 1
    while width * 2 <= size:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    rest = size - width
    return np.minimum(m[: len(m) - rest], m[rest:]) if rest else m


def suffix_runs(words: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first suffix, number of suffixes) of each run."""
    if len(words) < window:
        e = np.empty(0, np.uint64)
        return e, e.astype(np.int64), e.astype(np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    low = _smallest(_runs_hash(h, gram), window - gram + 1)
    first = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    n = np.diff(np.append(first, len(low)))
    if n.max() > window:  # a text that repeats itself
        parts = -(-n // window)
        at = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        n = np.minimum(np.repeat(n, parts) - at * window, window)
        first = np.repeat(first, parts) + at * window
    return low[first], first, n


def _contents(words: list[bytes], first: np.ndarray, n: np.ndarray, window: int) -> list[bytes]:
    """The words of each run, from its first suffix's begin to its last one's end."""
    text = b" ".join(words)
    begins = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], begins])
    return [text[a : b - 1] for a, b in zip(begins[first].tolist(), begins[first + n + window - 1].tolist())]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64), pa.int64())


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))


def _bitmaps(part: DataFrame) -> tuple[bytes, bytes]:
    """Bitmaps of the low BITMAP_BITS bits of all keys and of the open ones, put together by Spark: 2^(BITMAP_BITS-6) rows at most."""
    at = F.col("key").bitwiseAND(F.lit((1 << BITMAP_BITS) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    got = part.select(F.shiftright(at, 6).alias("i"), bit.alias("b"), F.when(F.col("open"), bit).otherwise(F.lit(0)).alias("o")).groupBy("i").agg(F.bit_or("b").alias("b"), F.bit_or("o").alias("o")).toArrow()
    out = []
    for name in ("b", "o"):
        bits = np.zeros(1 << BITMAP_BITS - 6, np.int64)
        bits[got.column("i").to_numpy()] = got.column(name).to_numpy()
        out.append(bits.tobytes())
    return out[0], out[1]


def tree_nodes(runs: list[bytes], counts: np.ndarray, owners: np.ndarray, window: int) -> np.ndarray:
    """For every suffix of the runs (run after run), the smallest owner below its node of depth `window`.

    Numbers stand for words; suffixes are told apart by their first 2, 4, 8 ... words, each step from the
    last one's order, until `window` words are. Sorted so, suffixes of one node are neighbours.
    """
    numbers: dict[bytes, int] = {}
    ids, sizes = [], []
    for r in runs:
        ws = r.split(b" ")
        ids += [numbers.setdefault(w, len(numbers)) for w in ws]
        sizes.append(len(ws))
    sizes = np.array(sizes, np.int64)
    at = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(np.cumsum(sizes) - sizes, counts)
    rank, width = np.array(ids, np.int64), 1
    while width * 2 <= window:
        rank = np.unique(rank[:-width] * (int(rank.max()) + 1) + rank[width:], return_inverse=True)[1]
        width *= 2
    deep = rank[at] * (int(rank.max()) + 1) + rank[at + window - width]
    order = np.argsort(deep, kind="stable")
    node = np.flatnonzero(np.concatenate([[True], deep[order][1:] != deep[order][:-1]]))
    least = np.minimum.reduceat(np.repeat(owners, counts)[order], node)
    out = np.empty(len(deep), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(node, len(deep))))
    return out


def _build_trees(window: int):
    """For mapInArrow over (g, key, sig, check, at, n, owner, words), rows of a group g together: the repeated suffixes of each run, counted from at."""

    def build(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        counts, owners = np.array([r[5] for r in rows], np.int64), np.array([r[6] for r in rows], np.int64)
        again = np.repeat(owners, counts) > tree_nodes([r[7] for r in rows], counts, owners, window)
        ends = np.cumsum(counts)
        out = [(*r[1:4], (np.flatnonzero(again[e - n : e]) + r[4]).tolist()) for r, e, n in zip(rows, ends.tolist(), counts.tolist()) if again[e - n : e].any()]
        if out:
            yield pa.RecordBatch.from_arrays([*(pa.array([o[i] for o in out], pa.int64()) for i in range(3)), pa.array([o[3] for o in out], pa.list_(pa.int64()))], [*_RUN, "offs"])

    def run(batches):
        rows, size, group = [], 0, None
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if r[0] != group and size >= AT_ONCE:
                    yield from build(rows)
                    rows, size = [], 0
                group = r[0]
                rows.append(r)
                size += r[5] + window - 1
        if rows:
            yield from build(rows)

    return frugal(run)


_GROUPED = ["g", *_RUN, "at", "n", "owner", "words"]


def _trees(grouped: DataFrame, words: int, window: int) -> DataFrame:
    """key, sig, check, offs of the repeated suffixes in grouped(g, key, sig, check, at, n, owner, words), which has so many words."""
    dealt = grouped.select(_GROUPED).repartition(1 + words // TASK_WORDS, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(_build_trees(window), "key long, sig long, check long, offs array<bigint>")


def _crowded(hot: DataFrame, window: int, group_words: int) -> DataFrame:
    """key, sig, check, offs for hot(key, sig, check, n, owner, words): runs of minimizers too crowded for one tree."""
    lengths = [max(1, round(window * x)) for x in DEPTHS] + [window]

    def single(batches):
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for key, sig, check, n, owner, words in zip(*(c.to_pylist() for c in b.columns)):
                ws = words.split(b" ")
                h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))
                second = np.fromiter((xxhash.xxh3_64_intdigest(w, 1) for w in ws), np.uint64, len(ws))
                row = [np.full(n, x) for x in (key, sig, check, owner)] + [np.arange(n)] + [_runs_hash(h, x)[:n].view(np.int64) for x in lengths] + [_runs_hash(second, window)[:n].view(np.int64)]
                for c, x in zip(cols, row):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols], [*_RUN, "owner", "at", "p0", "p1", "q0", "q1"])

    left = stored(hot.select(*_RUN, "n", "owner", "words").mapInArrow(frugal(single), "key long, sig long, check long, owner long, at long, p0 long, p1 long, q0 long, q1 long"), "crowded-suffixes")
    fits, most = [], group_words // window
    for depth, p in enumerate(("p0", "p1")):
        groups = stored(left.groupBy(p).agg(F.count(F.lit(1)).alias("m"), F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select(p, "m"), "prefixes")
        found = left.join(groups, p)
        fits.append(found.where(F.col("m") <= most).select(F.xxhash64(F.lit(depth), p).alias("g"), *_RUN, "at", "owner"))
        left = stored(found.where(F.col("m") > most).drop("m"), "crowded-suffixes")
    nodes = stored(left.groupBy("q0", "q1").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a < b").select("q0", "q1", "a"), "deep-nodes")
    deep = left.join(nodes, ["q0", "q1"]).where("owner > a").select(*_RUN, F.array("at").alias("offs"))

    def cut(batches):
        for b in batches:
            words = [b" ".join(w.split(b" ", o + window)[o : o + window]) for w, o in zip(b.column(7).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(words, pa.binary())], _GROUPED)

    grouped = stored(fits[0].unionByName(fits[1]), "parted-suffixes")
    text = grouped.join(hot.select(*_RUN, "words"), _RUN).select("g", *_RUN, "at", F.lit(1).cast("long").alias("n"), "owner", "words")
    text = text.mapInArrow(frugal(cut), "g long, key long, sig long, check long, at long, n long, owner long, words binary")
    return _trees(text, grouped.count() * window, window).unionByName(deep)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).cast("string").alias("text"))


def repeated_spans(docs: DataFrame, window: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", group_words: int = GROUP_WORDS) -> DataFrame:
    """doc_id, th (text hash), starts, counts: suffixes starts .. starts+counts-1 also start in a smaller document.

    Null ids are neither smaller nor larger than any, so rows with them lose nothing and cost others
    nothing. Rows of equal id are one document: they don't repeat each other. The result is stored.
    """
    spark = docs.sparkSession
    rows = _rows(docs, id_col, text_col).where("doc_id is not null")

    def light(batches):
        for c in rows_in_chunks(batches, "text"):
            keys, sigs, ids = [], [], []
            for d, t in zip(c["doc_id"], c["text"]):
                key, first, n = suffix_runs(words := words_spaced(t), window, gram)
                if len(key):
                    keys.append(key)
                    sigs.append(np.fromiter(map(xxhash.xxh3_64_intdigest, _contents(words, first, n, window)), np.uint64, len(key)))
                    ids.append(np.full(len(key), d))
            if keys:
                yield pa.RecordBatch.from_arrays([_signed(np.concatenate(keys)), _signed(np.concatenate(sigs)), pa.array(np.concatenate(ids), pa.int64())], ["key", "sig", "doc_id"])

    part = rows.select("doc_id", "text").mapInArrow(frugal(light), "key long, sig long, doc_id long")
    part = part.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.min("sig").alias("s"), F.max("sig").alias("z"))
    part = stored(part.where("a < b").select("key", (F.col("s") != F.col("z")).alias("open")), "minimizers")
    sent = spark.sparkContext.broadcast(_bitmaps(part))

    def full(batches):
        live, opened = (np.frombuffer(x, np.uint8) for x in sent.value)
        has = lambda bits, x: (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1
        for c in rows_in_chunks(batches, "text", 1_000_000):
            cols: list[list] = [[] for _ in range(5)]
            sigs, checks, texts = [], [], []
            for d, th, t in zip(c["doc_id"], c["th"], c["text"]):
                key, first, n = suffix_runs(words := words_spaced(t), window, gram)
                if not len(key):
                    continue
                low = key & np.uint64((1 << BITMAP_BITS) - 1)
                keep = np.flatnonzero(has(live, low))
                if not len(keep):
                    continue
                for col, x in zip(cols, (key[keep].view(np.int64), np.full(len(keep), d), np.full(len(keep), th), first[keep], n[keep])):
                    col.append(x)
                content = _contents(words, first[keep], n[keep], window)
                sigs += map(xxhash.xxh3_64_intdigest, content)
                checks += [xxhash.xxh64_intdigest(x, 1) for x in content]
                texts += [x if w else None for x, w in zip(content, has(opened, low[keep]).tolist())]
            if texts:
                key, *rest = (np.concatenate(x) for x in cols)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(_signed(np.array(x, np.uint64)) for x in (sigs, checks)), *(pa.array(x, pa.int64()) for x in rest), pa.array(texts, pa.binary())], [*_RUN, "doc_id", "th", "start", "n", "words"])

    runs = stored(rows.mapInArrow(frugal(full), "key long, sig long, check long, doc_id long, th long, start long, n long, words binary"), "suffix-runs")
    # the first document of each different run (stored, as a join that reuses an aggregation's partitioning
    # can't split a run that very many documents have)
    leaves = stored(runs.groupBy(*_RUN, "n", "words").agg(F.min("doc_id").alias("owner")), "leaves")
    size = F.col("n") + F.lit(window - 1)
    crowd = stored(leaves.where("words is not null").groupBy("key").agg(F.sum(size).alias("size"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "size"), "minimizer-sizes")
    sizes = crowd.agg(F.sum(F.when(F.col("size") <= group_words, F.col("size"))), F.max("size")).first()
    sized = leaves.where("words is not null").join(crowd, "key")
    nodes = _trees(sized.where(F.col("size") <= group_words).select(F.col("key").alias("g"), *_RUN, F.lit(0).cast("long").alias("at"), "n", "owner", "words"), sizes[0] or 0, window)
    if (sizes[1] or 0) > group_words:
        hot = stored(sized.where(F.col("size") > group_words).drop("size"), "crowded-runs")
        parts = _crowded(hot, window, group_words).groupBy(*_RUN).agg(F.flatten(F.collect_list("offs")).alias("offs"))  # at most `window` of a run
        nodes = nodes.unionByName(parts)
    named = stored(leaves.select(*_RUN, "owner").join(nodes, _RUN, "left"), "run-owners")
    found = runs.drop("words").join(named, _RUN).where("doc_id > owner or offs is not null")
    later = F.array(F.struct(F.col("start"), F.col("n")))
    some = F.transform("offs", lambda o: F.struct((F.col("start") + o).alias("start"), F.lit(1).cast("long").alias("n")))
    found = found.select("doc_id", "th", F.explode(F.when(F.col("doc_id") > F.col("owner"), later).otherwise(some)).alias("x"))
    # a document's runs: no more than its words
    spans = stored(found.groupBy("doc_id", "th").agg(F.collect_list("x.start").alias("starts"), F.collect_list("x.n").alias("counts")), "repeated-spans")
    discard(part, runs, leaves, crowd, named)
    return spans


def covered(n_words: int, starts, counts, window: int) -> np.ndarray:
    """Which of n_words words lie in a window that starts in one of the runs (start, count)."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, np.asarray(starts, np.int64), 1)
    np.add.at(edge, np.asarray(starts, np.int64) + np.asarray(counts, np.int64) + window - 1, -1)
    return edge[:n_words].cumsum() > 0


def remove_repeats(docs: DataFrame, window: int = 50, gram: int = 8, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept text, if asked for) for every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged; null, empty and blank texts have none. Ids compare as longs;
    rows with a null id keep every word. Repeated rows get a row each; other columns are ignored; an
    empty table gives no rows. Texts shorter than the window lose nothing.
    """
    spans = repeated_spans(docs, window, gram, id_col, text_col)

    def cut(batches):
        for c in rows_in_chunks(batches, "text"):
            out = []
            for t, starts, counts in zip(c["text"], c["starts"], c["counts"]):
                words = words_spaced(t)
                kept = words
                if starts:
                    gone = covered(len(words), starts, counts, window)
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out.append((len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode("utf-8", "surrogatepass") if with_text else None))
            arrays = [pa.array(c["doc_id"], pa.int64()), pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if with_text:
                arrays += [pa.array([o[3] for o in out], pa.string()), pa.array(c["th"], pa.int64())]
                names += ["kept_text", "th"]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = _rows(docs, id_col, text_col).join(spans.hint("shuffle_hash"), ["doc_id", "th"], "left")
    return rows.mapInArrow(frugal(cut), "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, th long" * with_text)


def documents_without_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """docs with each later copy of a passage cut out of its text, and n_chars, if there is such a column, set to the new length.

    Rows that lose nothing stay as they are; rows that lose every word go. Columns keep their types.
    """
    spans = repeated_spans(docs, window)
    names = docs.columns
    i, th, a, b = spare(docs, "id", "th", "starts", "counts")
    keyed = docs.withColumns({th: F.xxhash64("text"), i: F.col("doc_id").cast("long")})
    found = spans.select(F.col("doc_id").alias(i), F.col("th").alias(th), F.col("starts").alias(a), F.col("counts").alias(b))
    keyed = keyed.join(found.hint("shuffle_hash"), [i, th], "left").select(*names, a, b)

    def cut(batches):
        for b in batches:
            texts, at = b.column(names.index("text")).to_pylist(), b.schema.names
            sizes = b.column(names.index("n_chars")).to_pylist() if "n_chars" in names else [None] * len(texts)
            keep = []
            for i, (starts, counts) in enumerate(zip(b.column(len(names)).to_pylist(), b.column(len(names) + 1).to_pylist())):
                if starts:
                    words = words_spaced(texts[i])
                    gone = covered(len(words), starts, counts, window).tolist()
                    texts[i] = b" ".join(w for w, g in zip(words, gone) if not g).decode("utf-8", "surrogatepass")
                    sizes[i] = len(texts[i])
                    if not texts[i]:
                        continue
                keep.append(i)
            fresh = {"text": texts, "n_chars": sizes}
            cols = [pa.array(fresh[n], c.type) if n in fresh else c for n, c in zip(at, b.columns[: len(names)])]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(keep, pa.int64())) for c in cols], names)

    return keyed.mapInArrow(frugal(cut), docs.schema)
