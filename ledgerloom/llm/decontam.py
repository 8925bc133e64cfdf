"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of `window` consecutive benchmark words (a shorter item is one window). The
alphabet is words, a block is two neighbouring words: a shift table tells how far the search may jump
when a block ends no prefix position of any pattern, a bucket by the window's last block selects the
patterns to test, and a direct comparison confirms. Patterns of each length have tables of their own, so
one short item does not shorten the jumps of all others.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, frugal, rows_in_chunks, stored, words_alnum

#: Patterns whose tables go to the executors at once; more are searched in further passes.
MOST_PATTERNS = 400_000


def windows(words: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if words:
        for i in range(max(1, len(words) - size + 1)):
            yield tuple(words[i : i + size])


class WuManber:
    """Search for all patterns of one length m in a list of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], tuple[int, ...]], m: int):
        self.m, self.block = m, min(2, m)
        self.far = m - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for p, items in patterns.items():
            for j in range(self.block, m + 1):
                b = p[j - self.block : j] if self.block == 2 else p[0]
                self.shift[b] = min(self.shift.get(b, self.far), m - j)
            self.buckets[p[-2:] if self.block == 2 else p[0]].append((p, items))

    def search(self, words: list[bytes]) -> Iterator[tuple[int, tuple[int, ...]]]:
        """(start, items) of every occurrence."""
        m, far, n, shift = self.m, self.far, len(words), self.shift
        blocks = list(zip(words, words[1:])) if self.block == 2 else words
        i, back = m - 1, self.block - 1
        while i < n:
            b = blocks[i - back]
            s = shift.get(b, far)
            if s:
                i += s
                continue
            start = i - m + 1
            here = tuple(words[start : i + 1])
            for p, items in self.buckets.get(b, ()):
                if p == here:
                    yield start, items
            i += 1


def build(rows: list[tuple[tuple[bytes, ...], tuple[int, ...]]]) -> list[WuManber]:
    by_length: dict[int, dict] = defaultdict(dict)
    for p, items in rows:
        by_length[len(p)][p] = items
    return [WuManber(p, m) for m, p in sorted(by_length.items())]


def scan(text: str | None, searchers: list[WuManber]) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, merged hit intervals [a, b) and the items found."""
    words = words_alnum(text)
    spans, items = [], set()
    for s in searchers:
        for start, found in s.search(words):
            spans.append((start, start + s.m))
            items.update(found)
    merged: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return len(words), merged, items


def _pattern_rows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    def cut(batches):
        for b in batches:
            out = [(i, b" ".join(w)) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in windows(words_alnum(t), window)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["item_id", "pattern"])

    return (
        benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).where("item_id is not null and text is not null")
        .mapInArrow(cut, "item_id long, pattern binary").groupBy("pattern").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )


_OUT = "rid long, doc_id long, n_words long, spans array<struct<a:int,b:int>>, items array<bigint>"


def find_occurrences(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """doc_id, n_words, spans (merged hit word intervals), items for each row of docs.

    A null text has no words; a null item or item text gives no pattern; repeated items count once;
    repeated rows of docs each get a row; other columns are ignored. While the patterns fit
    `most_patterns` (a count is taken first) one pass over docs does; else docs are searched in one pass
    for each block of patterns, and the passes are brought together by id and text hash.
    """
    spark = docs.sparkSession
    patterns = stored(_pattern_rows(benchmark, item_col, item_text_col, window), "patterns")
    n = patterns.count()
    blocks = max(1, -(-n // most_patterns))
    rows = docs.select(F.xxhash64(text_col).alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def searched(block: int) -> DataFrame:
        mine = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()  # at most about most_patterns
        sent = spark.sparkContext.broadcast([(tuple(bytes(r.pattern).split(b" ")), tuple(r["items"])) for r in mine])

        def run(batches):
            searchers = build(sent.value)
            for c in rows_in_chunks(batches, "text"):
                got = [scan(t, searchers) for t in c["text"]]
                yield pa.RecordBatch.from_pydict({
                    "rid": pa.array(c["rid"], pa.int64()), "doc_id": pa.array(c["doc_id"], pa.int64()),
                    "n_words": pa.array([g[0] for g in got], pa.int64()),
                    "spans": pa.array([[{"a": a, "b": b} for a, b in g[1]] for g in got], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))),
                    "items": pa.array([sorted(g[2]) for g in got], pa.list_(pa.int64())),
                })

        return rows.mapInArrow(frugal(run), _OUT)

    if blocks == 1:
        out = searched(0)
    else:
        # a repeated row is the same in every pass: number the repeats by counting, then bring passes together
        parts = searched(0)
        for b in range(1, blocks):
            parts = parts.unionByName(searched(b))
        out = (
            parts.groupBy("rid", "doc_id").agg(
                F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), (F.count(F.lit(1)) / blocks).cast("int").alias("times"))
            .withColumn("again", F.explode(F.sequence(F.lit(1), F.col("times")))).drop("times", "again")
        )
        out = out.withColumn("spans", _merged(F.col("spans")))
    return out.drop("rid")


def _merged(spans: Column) -> Column:
    """Intervals in order, with those that touch or overlap made one."""
    none = F.array().cast("array<struct<a:int,b:int>>")

    def add(done: Column, s: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"))))
        return F.when(s["a"] <= last["b"], grown).otherwise(F.concat(done, F.array(s)))

    return F.aggregate(spans, none, add)


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, text_col: str = "text", most_patterns: int = MOST_PATTERNS) -> DataFrame:
    """The rows of docs without any occurrence: one filtering pass for each block of patterns.

    What a pass keeps is stored before the next, so that no task holds the tables of two blocks.
    """
    patterns = stored(_pattern_rows(benchmark, "item_id", "text", window), "patterns")
    blocks = max(1, -(-patterns.count() // most_patterns))
    at, before = docs.columns.index(text_col), None
    for block in range(blocks):
        mine = patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == block).collect()
        sent = docs.sparkSession.sparkContext.broadcast([(tuple(bytes(r.pattern).split(b" ")), tuple(r["items"])) for r in mine])

        def run(batches, sent=sent):
            searchers = build(sent.value)
            for b in batches:
                clean = [not any(True for s in searchers for _ in s.search(words)) for words in map(words_alnum, (x.as_py() for x in b.column(at)))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(frugal(run), docs.schema)
        if block + 1 < blocks:
            docs = stored(docs, "clean")
            if before is not None:
                discard(before)
            before = docs
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The digest columns of find_occurrences' rows."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["b"] - s["a"]).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
