"""What the training-data operators share: table access, shared scratch space, Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The three word definitions that the operators use, as byte classes.
_SPACE = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)

_own_folders: dict[str, str] = {}
_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, which need not see the driver's folders; once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), "ledgerloom-package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in sorted(os.walk(package)):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset a local master gets a folder of its own, a cluster an error."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = sc.applicationId
        if app not in _own_folders:
            _own_folders[app] = tempfile.mkdtemp(prefix="ledgerloom-")
        base = _own_folders[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared scratch space and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what stored() wrote; only for tables whose every reader has been stored itself."""
    for df in tables:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def frugal(run: Callable) -> Callable:
    """A function for mapInArrow that gives free memory back to the system when its task ends, as Python workers live on."""

    def call(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    return call


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme of the file system that Spark would use for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def spare(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores before those that df has already."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
    return out


def words_spaced(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` as UTF-8; no words for null."""
    if not text:
        return []
    return [w for w in text.encode("utf-8", "surrogatepass").translate(_SPACE).split(b" ") if w]


def words_alnum(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split()


def lower_ascii(words: Iterable[bytes]) -> list[bytes]:
    return [w.lower() for w in words]


def total(columns: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def rows_in_chunks(batches: Iterator[pa.RecordBatch], text: str, most_chars: int = 4_000_000) -> Iterator[dict]:
    """Columns of rows as lists, in runs of about most_chars characters of text; a longer text stands alone."""
    for batch in batches:
        cols = {n: c for n, c in zip(batch.schema.names, batch.columns)}
        lengths = pc.fill_null(pc.binary_length(cols[text]), 0).to_pylist()
        start, size = 0, 0
        for i, n in enumerate(lengths):
            if i > start and size + n > most_chars:
                yield {k: c.slice(start, i - start).to_pylist() for k, c in cols.items()}
                start, size = i, 0
            size += n
        if start < len(lengths):
            yield {k: c.slice(start).to_pylist() for k, c in cols.items()}


def fold(column: str, remainder: int, of: int) -> Column:
    """crc32 of the id written as text, modulo `of`, equals remainder (false for null ids)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % of == remainder, F.lit(False))
