"""SimHash fingerprints linked by covering locality-sensitive hashing.

Every bit position i has a vector a(i) of r+1 bits; the table of a non-zero vector v keeps the bits with
<a(i), v> = 1. Any r positions leave some v orthogonal to all their vectors, so two fingerprints that
differ in at most r bits agree in all kept bits of some table: no pair within the radius is missed.
"""

from __future__ import annotations

from itertools import accumulate, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import frugal, lower_ascii, rows_in_chunks, spare, stored, words_spaced
from .graph import components

BITS = 64
#: Bucket sizes up to which pairs are compared by a join, and by one task.
JOINED, IN_TASK = 64, 4096
#: Texts, and bytes of shingle sets for each, that a block of a bucket has in the pipeline's stage.
BLOCK, SET_BYTES = 1000, 8000


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1)-1 masks such that any `radius` bits are all absent from one of them."""
    m = (1 << (radius + 1)) - 1
    vector = [1 + i % m for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (vector[i] & v).bit_count() & 1) for v in range(1, m + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle, repeats included; a shorter text is one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    buf = b" ".join(words)
    if n <= k:
        return np.array([xxhash.xxh64_intdigest(buf, 42)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    pieces = [buf[s : e - 1] for s, e in zip(starts, starts[k:])]
    return np.fromiter(map(xxhash.xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))


def simhash(hashes: np.ndarray) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 65536):
        part = np.ascontiguousarray(hashes[i : i + 65536])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    def run(batches):
        for c in rows_in_chunks(batches, "text"):
            fp = [simhash(shingle_hashes(lower_ascii(words_spaced(t)), k)) for t in c["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(c["doc_id"], pa.int64()), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(frugal(run), "doc_id long, fp long")


def table_keys(fp: Column, radius: int) -> Column:
    """array<struct<t, k>>: the fingerprint's key in each covering table."""
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in enumerate(covering_masks(radius))])


def forest(fp: np.ndarray, node: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links (smallest node, node) of a spanning star of each set connected within the radius."""
    left, out = np.arange(len(fp)), []
    while len(left):
        found, wave, left = [left[:1]], left[:1], left[1:]
        while len(wave) and len(left):
            near = np.zeros(len(left), bool)
            for i in range(0, len(wave), 256):
                near |= (np.bitwise_count(fp[left][None, :] ^ fp[wave[i : i + 256]][:, None]) <= radius).any(0)
            wave, left = left[near], left[~near]
            found.append(wave)
        if len(members := np.concatenate(found)) > 1:
            ids = node[members]
            out += [(int(ids.min()), int(x)) for x in ids if x != ids.min()]
    return out


def links(classes: DataFrame, radius: int = 2) -> DataFrame:
    """Links a, b between classes(fp, node) that connect just what pairs within the radius connect.

    Small buckets of a table are compared by a join. In larger ones a task compares up to IN_TASK
    fingerprints and returns spanning stars, never all pairs. A still larger bucket is cut by one of
    radius+1 groups of the bits its table leaves out (one of them agrees in a pair within the radius),
    and what is larger even then is dealt as pairs of blocks.
    """
    masks = covering_masks(radius)
    keyed = classes.where("node is not null").select("fp", "node", F.explode(table_keys(F.col("fp"), radius)).alias("x")).select("fp", "node", "x.t", "x.k")
    sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = stored(keyed.join(sizes, ["t", "k"]), "simhash-buckets")
    largest = members.agg(F.max("n")).first()[0] or 0
    small = members.where(F.col("n") <= JOINED)
    other = small.select("t", "k", F.col("fp").alias("fp2"), F.col("node").alias("b"))
    out = small.join(other, ["t", "k"]).where((F.col("fp") < F.col("fp2")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius)).select(F.col("node").alias("a"), "b")
    if largest <= JOINED:
        return out

    def star(pdf):
        got = forest(pdf["fp"].to_numpy().view(np.uint64), pdf["node"].to_numpy(), radius)
        return pd.DataFrame({"a": [x[0] for x in got], "b": [x[1] for x in got]}, dtype="int64")

    none = F.lit(0).cast("long")
    groups = members.where(f"n > {JOINED} and n <= {IN_TASK}").select("fp", "node", "t", "k", F.lit(-1).alias("c"), none.alias("p"), none.alias("q"))
    if largest > IN_TASK:
        rest = [[i for i in range(BITS) if not m >> i & 1] for m in masks]
        parts = [[_signed(sum(1 << i for i in r[c :: radius + 1])) for c in range(radius + 1)] for r in rest]
        cut = F.create_map(*[x for t, p in enumerate(parts) for x in (F.lit(t), F.array(*map(F.lit, p)))])
        fine = members.where(f"n > {IN_TASK}").select("fp", "node", "t", "k", F.posexplode(cut[F.col("t")]).alias("c", "m"))
        fine = fine.select("fp", "node", "t", "c", F.xxhash64("k", F.col("fp").bitwiseAND(F.col("m"))).alias("k"))
        again = fine.groupBy("t", "c", "k").agg(F.count(F.lit(1)).alias("n2")).where("n2 > 1")
        fine = fine.join(again, ["t", "c", "k"]).withColumn("blocks", F.ceil(F.col("n2") * 2 / IN_TASK)).withColumn("mine", F.pmod(F.xxhash64("fp"), F.col("blocks")))
        fine = fine.withColumn("yours", F.explode(F.sequence(none, F.col("blocks") - 1)))
        groups = groups.unionByName(fine.select("fp", "node", "t", "k", "c", F.least("mine", "yours").alias("p"), F.greatest("mine", "yours").alias("q")))
    return out.unionByName(groups.groupBy("t", "k", "c", "p", "q").applyInPandas(star, "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased. Null, empty and blank texts have fingerprint zero
    and link like any other. A null id takes part through its fingerprint, but a fingerprint that only
    rows with null ids have forms no links and gets a null component. Repeated rows each get a row;
    other columns are ignored; an empty table gives no rows.
    """
    fps = stored(fingerprints(docs, k, id_col, text_col), "fingerprints")
    classes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-classes")
    roots = components(links(classes, radius))
    named = classes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# ---- the pipeline's stage: documents whose shingle sets have a Jaccard similarity of at least 0.8


def _sketch(hashes: np.ndarray, views: int) -> tuple[int, list[int]]:
    """Fingerprint of all shingles, and fingerprints of `views` samples of three shingles.

    At a similarity of 0.8 whole fingerprints differ in some 10 of 64 bits, which no affordable covering
    reaches. A sample takes the shingle that comes first in each of three fixed orders, so that samples
    of similar sets are often equal, and so are their fingerprints.
    """
    out = []
    for v in range(views):
        firsts = []
        for j in range(3):
            mixed = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (3 * v + j + 1) & (1 << 64) - 1)) * np.uint64(0xFF51AFD7ED558CCD)
            mixed ^= mixed >> np.uint64(33)
            firsts.append(hashes[int((mixed * np.uint64(0xC4CEB9FE1A85EC53)).argmin())])
        out.append(simhash(np.array(firsts, np.uint64)))
    return simhash(hashes), out


def near_duplicate_classes(docs: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = 2, views: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """k1, k2 (text hashes), oid (smallest id; null ids count as the largest long), copies (rows with that id),
    node (the text's number in order of oid, k1, k2), root (smallest node of its group): one row for each
    different text of docs; texts of one root are a group of near copies.

    Equal texts are one class. Candidates share a covering-table key of their fingerprint or a view's
    fingerprint; a candidate counts if the Jaccard similarity of the k-word shingle sets is at least
    `similarity`. A bucket's texts are compared with its smallest node first, then those of different
    groups with each other. Texts without words are linked only if equal.
    """
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("oid"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(text_col).alias("k1"), F.xxhash64(F.lit("second"), F.col(text_col)).alias("k2"),
    )
    # one row for each text: only these are fingerprinted
    ids = rows.groupBy("k1", "k2", "oid").agg(F.count(F.lit(1)).alias("n"))
    ids = ids.groupBy("k1", "k2").agg(F.min("oid").alias("oid"), F.min_by("n", "oid").alias("copies"))
    # different texts may have one id or none: a node is the text's own, and rises with the id
    order = ["oid", "k1", "k2"]
    ids = stored(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "text-classes")

    def sketch(batches):
        for c in rows_in_chunks(batches, "text"):
            got = [_sketch(h, views) if len(h := np.unique(shingle_hashes(lower_ascii(words_spaced(t)), k))) else (None, None) for t in c["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(c["oid"], pa.int64()), pa.array(c["k1"], pa.int64()), pa.array(c["k2"], pa.int64()), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["oid", "k1", "k2", "fp", "views"])

    sk = stored(rows.mapInArrow(frugal(sketch), "oid long, k1 long, k2 long, fp long, views array<bigint>"), "sketches")
    sk = sk.where("fp is not null").join(ids, ["oid", "k1", "k2"]).dropDuplicates(["oid", "k1", "k2"])
    n_masks = len(covering_masks(radius))
    view_keys = F.transform("views", lambda x, i: F.struct((i + n_masks).alias("t"), x.alias("k")))
    keyed = sk.select("node", F.explode(F.concat(table_keys(F.col("fp"), radius), view_keys)).alias("x")).select("node", "x.t", "x.k")
    firsts = keyed.groupBy("t", "k").agg(F.min("node").alias("rep"), F.max("node").alias("top")).where("rep < top").drop("top")
    others = stored(keyed.join(firsts, ["t", "k"]).where("rep < node").select("t", "k", "rep", "node"), "simhash-buckets")
    held = _shingle_sets(others.select("node").union(others.select("rep")).distinct(), rows, ids, k)
    roots = stored(components(_verified(others.select("rep", "node").distinct(), held, similarity)), "roots")
    # groups of the first comparison that one of the second links: its edges are between their roots
    again = components(_within_buckets(others, roots, held, similarity)).select(F.col("node").alias("root"), F.col("root").alias("low"))
    named = ids.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    roots = named.join(again, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
    return ids.join(roots, "node", "left").select("k1", "k2", "oid", "copies", "node", F.coalesce("root", "node").alias("root"))


def _shingle_sets(need: DataFrame, rows: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """node, s (sorted 32-bit shingle hashes) of the nodes in need."""
    need = ids.join(need, "node").select("oid", "k1", "k2", "node")

    def sets(batches):
        for c in rows_in_chunks(batches, "text"):
            got = [np.unique(shingle_hashes(lower_ascii(words_spaced(t)), k).astype(np.uint32)).tobytes() for t in c["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(c["node"], pa.int64()), pa.array(got, pa.binary())], ["node", "s"])

    return stored(rows.join(need.hint("shuffle_hash"), ["oid", "k1", "k2"]).select("node", "text").mapInArrow(frugal(sets), "node long, s binary").dropDuplicates(["node"]), "shingle-sets")

def _verified(pairs: DataFrame, held: DataFrame, similarity: float, per_task: int = 2000) -> DataFrame:
    """Those of pairs(rep, node) whose shingle sets are similar enough, as a, b."""
    tasks = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / per_task).alias("tasks"))
    members = pairs.join(tasks, "rep").select("rep", F.pmod(F.xxhash64("node"), F.col("tasks")).alias("salt"), "node").join(held, "node").select("rep", "salt", "node", "s")
    heads = tasks.join(held, F.col("rep") == F.col("node")).select("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("salt"), F.col("rep").alias("node"), "s")

    def compare(batches):
        rep = own = None
        for b in batches:
            out = []
            for r, n, s in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                x = np.frombuffer(s, np.uint32)
                if r == n:  # the first of its group: nodes are larger
                    rep, own = r, x
                elif r == rep:
                    both = len(np.intersect1d(own, x, assume_unique=True))
                    if both >= similarity * (len(own) + len(x) - both):
                        out.append((r, n))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], ["a", "b"])

    return heads.unionByName(members).repartition("rep", "salt").sortWithinPartitions("rep", "salt", "node").mapInArrow(frugal(compare), "a long, b long")


def similar_links(sets: list[np.ndarray], group: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links of groups that connect just what similar pairs of sets connect.

    Of similar sets, the rarest elements (all but a `similarity` share, and one more) have one in common,
    and the smaller has that share of the larger's size: only such pairs of unlinked groups are compared.
    """
    sizes = np.array([len(x) for x in sets])
    _, element, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.empty(len(counts), np.int64)
    place[np.argsort(counts, kind="stable")] = np.arange(len(counts))
    shared = np.sort(counts, kind="stable") > 1  # by place
    ends = np.cumsum(sizes)
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    seen: dict[int, list[int]] = {}
    out = []
    for i in np.argsort(sizes, kind="stable").tolist():
        n = int(sizes[i])
        first = n - int(np.ceil(similarity * n - 1e-9)) + 1
        mine = np.sort(place[element[ends[i] - n : ends[i]]])[:first]
        mine = mine[shared[mine]].tolist()
        for j in set().union(*[seen[x] for x in mine if x in seen]):
            if sizes[j] >= similarity * n and (a := find(int(group[i]))) != (b := find(int(group[j]))):
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (n + int(sizes[j]) - both):
                    up[max(a, b)] = min(a, b)
                    out.append((min(a, b), max(a, b)))
        for x in mine:
            seen.setdefault(x, []).append(i)
    return out


def _within_buckets(others: DataFrame, roots: DataFrame, held: DataFrame, similarity: float) -> DataFrame:
    """Links a, b between the groups of roots(node, root) that similar texts of a bucket in others(t, k, rep, node) connect.

    Buckets of one group need nothing more, and of buckets with the same texts one is enough. A bucket
    of more than BLOCK texts, or of texts as large as BLOCK of SET_BYTES, is dealt as pairs of blocks.
    """
    size = held.select("node", F.length("s").cast("long").alias("bytes"))
    x = others.select("t", "k", "node").join(roots, "node", "left").join(size, "node").select("t", "k", "node", F.coalesce("root", "node").alias("g"), "bytes")
    texts = [F.sum(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1 << 31))).alias(name) for seed, name in ((1, "h1"), (2, "h2"))]
    need = x.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"), F.min("g").alias("low"), F.max("g").alias("high"), *texts).where("low < high")
    need = need.groupBy("n", "bytes", "h1", "h2").agg(F.min(F.struct("t", "k")).alias("at")).select("at.t", "at.k", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("bytes") / (BLOCK * SET_BYTES))).cast("long").alias("blocks"))
    none = F.lit(0).cast("long")
    x = x.drop("bytes").join(need, ["t", "k"]).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("yours", F.explode(F.sequence(none, F.col("blocks") - 1)))
    x = x.select("t", "k", "node", "g", F.least("mine", "yours").alias("p"), F.greatest("mine", "yours").alias("q"))

    def link(pdf):
        got = similar_links([np.frombuffer(s, np.uint32) for s in pdf["s"]], pdf["g"].to_numpy(), similarity)
        return pd.DataFrame({"a": [x[0] for x in got], "b": [x[1] for x in got]}, dtype="int64")

    return x.join(held, "node").groupBy("t", "k", "p", "q").applyInPandas(link, "a long, b long")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with one document of each group of near copies: that with the smallest id."""
    cols = docs.columns
    k1, k2, oid, copies = spare(docs, "k1", "k2", "oid", "copies")
    kept = near_duplicate_classes(docs, **options).where("node = root").select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("oid").alias(oid), F.col("copies").alias(copies))
    keyed = docs.withColumns({k1: F.xxhash64("text"), k2: F.xxhash64(F.lit("second"), F.col("text")), oid: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1))})
    found = stored(keyed.join(kept.hint("shuffle_hash"), [k1, k2, oid]).select(*cols, k1, k2, copies), "kept")
    once = found.where(F.col(copies) == 1).unionByName(found.where(F.col(copies) > 1).dropDuplicates([k1, k2]))
    return once.select(*cols)
