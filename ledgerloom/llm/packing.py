"""Sequence packing: shortest-pack-first over the histogram of piece lengths.

A document's ids are cut into pieces of `capacity`; its rest is a piece of its own. The driver holds only
the histogram (at most `capacity` lengths) and packs it: lengths are placed longest first, each into the
packs that are shortest so far, and what is kept are packing patterns with counts. Pieces of a length
then take the places that patterns have for it, by rank.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import frugal, rows_in_chunks, stored

#: In such a text a letter followed by something else ends a token, and a character stands for itself.
_PLAIN = re.compile(r"[\x00-\x7fÀ-ÖØ-öø-ÿ]*")
#: A blank-free run: up to its last letter, and what follows that.
_TAIL = re.compile(r"(.*[a-zß-öø-ÿ])([^a-zß-öø-ÿ]+)", re.DOTALL)


_LETTERS = re.compile(r"[a-zß-öø-ÿ]+")


class _Known(dict):
    """Ids (little-endian uint32) of blank-free runs, found when first asked for.

    A run of letters alone is one pre-token: it goes to the tokenizer's model, past the normalizer and
    the splitting, which leave it as it is.
    """

    def __init__(self, tokenizer, plain: bool):
        from tokenizers.pre_tokenizers import ByteLevel

        self.encode, self.tokenize, self.plain = tokenizer.encode, tokenizer.model.tokenize, plain
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.shown = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}

    def __missing__(self, run: str) -> bytes:
        if self.plain and _LETTERS.fullmatch(run):
            ids = array("I", [t.id for t in self.tokenize(run.translate(self.shown))]).tobytes()
        elif self.plain and (m := _TAIL.fullmatch(run)):
            ids = self[m[1]] + self[m[2]]
        else:
            ids = array("I", self.encode(run, add_special_tokens=False).ids).tobytes()
        if len(run) <= 64:
            self[run] = ids
        return ids


class CachedTokenizer:
    """Ids of whole texts through a bounded cache of runs that the vocabulary's splitting keeps apart.

    Blank space always parts tokens, and in a text of ASCII and Latin-1 letters so does the end of a run
    of letters: tokenizing the runs one by one gives the ids of the whole. Other texts are only parted at
    blank space. A text in which an added token stands is tokenized whole. A task has one of its own:
    at most `most` runs of up to 64 characters, some 40 MB.
    """

    def __init__(self, path: str, most: int = 200_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        # runs come from texts without an added token, but lower-casing may write one
        self.tokenizer.encode_special_tokens = True
        self.most, self.plain, self.other = most, _Known(self.tokenizer, True), _Known(self.tokenizer, False)

    def _whole(self, text: str) -> bytes:
        """Ids by the tokenizer as it is dealt."""
        self.tokenizer.encode_special_tokens = False
        try:
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        finally:
            self.tokenizer.encode_special_tokens = True

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32."""
        out = []
        for t in texts:
            if self.added.search(t):
                out.append(self._whole(t))
                continue
            if plain := _PLAIN.fullmatch(t):
                t = t.lower()
            known = self.plain if plain else self.other
            if len(self.plain) + len(self.other) > self.most:
                self.plain.clear()
                self.other.clear()
            runs = t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            out.append(b"".join(map(known.__getitem__, runs)))
        return out


@dataclass
class Pattern:
    """`count` sequences, each holding `times` pieces of each `length`, in this order."""

    count: int
    items: list[tuple[int, int]]  # (length, times)


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Shortest-pack-first: every piece of the histogram placed, no pattern longer than capacity."""
    packs: list[tuple[int, int, int, tuple | None]] = []  # heap: shortest first; (length, tie, count, linked items)
    done: list[tuple[int, tuple | None]] = []
    tie = 0

    def put(length: int, count: int, items: tuple | None) -> None:
        nonlocal tie
        tie += 1
        if length == capacity:
            done.append((count, items))
        else:
            heapq.heappush(packs, (length, tie, count, items))

    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        left = histogram[length]
        while left:
            if packs and packs[0][0] + length <= capacity:
                have, _, count, items = heapq.heappop(packs)
                nxt = packs[0][0] if packs else capacity
                # as often as it stays the shortest pack, but into no more packs than there are pieces
                times = max(1, min((nxt - have) // length, (capacity - have) // length, left // count))
                if left < count:
                    put(have, count - left, items)
                    count = left
                put(have + times * length, count, (length, times, items))
                left -= times * count
            else:
                # a new pack is the shortest until it has no room for this length
                fit = capacity // length
                for count, times in ((left // fit, fit), (1, left % fit)):
                    if count and times:
                        put(times * length, count, (length, times, None))
                left = 0
    out = []
    for count, items in done + [(c, i) for _, _, c, i in packs]:
        flat: list[tuple[int, int]] = []
        while items is not None:
            length, times, items = items
            flat.append((length, times))
        out.append(Pattern(count, flat[::-1]))
    return out


def _places(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, times, first offset) by first rank."""
    out: dict[int, list] = {}
    used: dict[int, int] = {}
    sequence = 0
    for p in patterns:
        offset = 0
        for length, times in p.items:
            r = used.get(length, 0)
            out.setdefault(length, []).append((r, sequence, times, offset))
            used[length] = r + times * p.count
            offset += times * length
        sequence += p.count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def place(length: np.ndarray, rank: np.ndarray, places: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of the pieces with these lengths and ranks (from 0 within a length)."""
    sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for x in np.unique(length):
        at = np.flatnonzero(length == x)
        table = places[int(x)]
        row = table[np.searchsorted(table[:, 0], rank[at], side="right") - 1]
        i = rank[at] - row[:, 0]
        sequence[at] = row[:, 1] + i // row[:, 2]
        offset[at] = row[:, 3] + (i % row[:, 2]) * int(x)
    return sequence, offset


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids, if asked for) of every piece."""

    def run(batches):
        tk, end = CachedTokenizer(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for c in rows_in_chunks(batches, "text"):
            out = []
            for d, ids in zip(c["doc_id"], tk.ids([t or "" for t in c["text"]])):
                ids += end
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    part = ids[4 * s : 4 * (s + capacity)]
                    out.append((d, s, len(part) // 4, zlib.crc32(part), n, part))
            cols = list(zip(*out))
            arrays = [pa.array(cols[i], pa.int64()) for i in range(5)] + ([pa.array([np.frombuffer(x, "<u4") for x in cols[5]], pa.list_(pa.int64()))] if with_ids else [])
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(arrays)])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<bigint>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), schema)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece (and its ids, if asked for).

    A null or empty text is the end id alone. Repeated rows are packed each. Ties within a length go by
    (hash bucket, doc_id, start, crc); rows equal in all of these are interchangeable. Other columns are
    ignored; an empty table gives no rows. Full pieces are their own sequences; ranks within a length are
    taken in hash buckets whose number follows the row count, so no length is ranked by one task.
    """
    spark: SparkSession = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    buckets = 256 * (1 + sum(counts.values()) // 50_000_000)
    sent = spark.sparkContext.broadcast(_places(pack_histogram(counts, capacity)))
    names = cut.columns
    keyed = cut.withColumn("b", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)))
    before = keyed.groupBy("length", "b").agg(F.count(F.lit(1)).alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = keyed.withColumn("i", F.row_number().over(Window.partitionBy("length", "b").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1)
    ranked = ranked.join(before, ["length", "b"]).select(*names, (F.col("i") + F.col("before")).cast("long").alias("rank"))

    def run(batches):
        for b in batches:
            seq, off = place(b.column(names.index("length")).to_numpy(), b.column(len(names)).to_numpy(), sent.value)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(frugal(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long")
