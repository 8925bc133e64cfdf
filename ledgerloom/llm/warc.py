"""WARC records in ZIP archives, read back by ranges.

An archive is a ZIP file with stored (not deflated) members: archive/data.warc.gz, one gzip member a
record, and indexes/index.cdxj, a line a record with its place. The reader parses the end-of-directory
records (ZIP64 ones too), the central directory and a member's local header, takes the index from its
range, and reads single records by their ranges: nothing is extracted, no archive is read whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import zipfile
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, qualified, rows_in_chunks, scratch, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_EOCD, _EOCD64, _LOCATOR, _CENTRAL, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    offset: int  # of the local header
    size: int


def read_range(f, start: int, size: int) -> bytes:
    f.seek(start)
    got = f.read(size)
    if len(got) != size:
        raise ValueError(f"range {start}+{size} is not there")
    return got


def directory(f, length: int) -> dict[str, Member]:
    """The members of the ZIP file f of this length, by its central directory."""
    tail_at = max(0, length - 65_557 - 20)
    tail = read_range(f, tail_at, length - tail_at)
    at = tail.rfind(_EOCD)
    if at < 0:
        raise ValueError("no end of central directory")
    count, size, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == _LOCATOR and (count == 0xFFFF or size == 0xFFFFFFFF or start == 0xFFFFFFFF):
        (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end64 = read_range(f, where, 56)
        if end64[:4] != _EOCD64:
            raise ValueError("no ZIP64 end of central directory")
        count, size, start = struct.unpack("<QQQ", end64[32:56])
    raw, at, out = read_range(f, start, size), 0, {}
    for _ in range(count):
        if raw[at : at + 4] != _CENTRAL:
            raise ValueError("broken central directory")
        method = struct.unpack("<H", raw[at + 10 : at + 12])[0]
        packed, full, n_name, n_extra, n_comment = struct.unpack("<IIHHH", raw[at + 20 : at + 34])
        (offset,) = struct.unpack("<I", raw[at + 42 : at + 46])
        name = raw[at + 46 : at + 46 + n_name].decode()
        extra = raw[at + 46 + n_name : at + 46 + n_name + n_extra]
        while len(extra) >= 4:  # ZIP64 extra field: only what the fixed part marks, in this order
            kind, n = struct.unpack("<HH", extra[:4])
            if kind == 1:
                long, i = extra[4 : 4 + n], 0
                if full == 0xFFFFFFFF:
                    full, i = struct.unpack("<Q", long[i : i + 8])[0], i + 8
                if packed == 0xFFFFFFFF:
                    packed, i = struct.unpack("<Q", long[i : i + 8])[0], i + 8
                if offset == 0xFFFFFFFF:
                    offset = struct.unpack("<Q", long[i : i + 8])[0]
            extra = extra[4 + n :]
        out[name] = Member(name, method, offset, packed)
        at += 46 + n_name + n_extra + n_comment
    return out


def data_start(f, m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method:
        raise ValueError(f"{m.name} is not stored")
    head = read_range(f, m.offset, 30)
    if head[:4] != _LOCAL:
        raise ValueError("no local header")
    n_name, n_extra = struct.unpack("<HH", head[26:30])
    return m.offset + 30 + n_name + n_extra


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record: a response, or a revisit of the record of page refers_to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's parts: page_id, url, type, refers_to, payload_bytes, payload_digest, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
    urn = lambda s: int(x) if (x := s[len("<urn:page:") : -1]) else None
    got = {"page_id": urn(fields["WARC-Record-ID"]), "url": json.loads(f'"{fields["WARC-Target-URI"]}"'), "record_type": fields["WARC-Type"], "refers_to": urn(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None,
           "payload_bytes": size, "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "payload": None}
    if got["record_type"] == "response":
        if len(payload) != size or digest(payload) != got["payload_digest"]:
            raise ValueError(f"payload of page {got['page_id']} is broken")
        got["payload"] = payload
    return got


class Writer:
    """One archive. Its name holds the task attempt, so that attempts of a task never write to one file;
    only archives of attempts that end are listed."""

    def __init__(self, folder: str, name: str):
        files, root = fs.FileSystem.from_uri(folder)
        self.name = f"{folder}/{name}"
        self.out = files.open_output_stream(f"{root}/{name}")
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(DATA, "w", force_zip64=True)
        self.index: list[bytes] = []
        self.size = 0

    def add(self, raw: bytes, page_id: int | None) -> None:
        packed = gzip.compress(raw, 1, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps({"id": page_id, "offset": self.size, "length": len(packed)}).encode() + b"\n")
        self.size += len(packed)

    def close(self) -> tuple[str, int, int]:
        self.data.close()
        self.zip.writestr(INDEX, b"".join(self.index))
        self.zip.close()
        self.out.close()
        return self.name, len(self.index), self.size


def write_archives(pages: DataFrame, folder: str | None = None, archive_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each row of pages into archives in a shared folder; returns (archive, records, bytes).

    Of rows with equal payload the smallest id is the response; rows that repeat that id with the same
    payload are responses too. A null payload is an empty one. A row with a null id is a revisit if a row
    with an id has its payload, else a response. Other columns are ignored; no rows make no archive.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder or scratch(spark, "warc"))
    files, root = fs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    sums = rows.select("page_id", F.sha1(F.col("html").cast("binary")).alias("d"))
    firsts = sums.groupBy("d").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    refers = sums.join(firsts, "d").where("page_id is null or page_id > first").select(F.col("page_id").alias("id"), F.col("d"), F.col("first").alias("refers_to")).distinct()
    keyed = rows.withColumn("h", F.sha1(F.col("html").cast("binary"))).join(refers.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("d")), "left")

    def run(batches):
        task, made, writer = TaskContext.get(), [], None
        for c in rows_in_chunks(batches, "html"):
            for i, url, html, refers_to in zip(c["page_id"], c["url"], c["html"], c["refers_to"]):
                if writer is None:
                    writer = Writer(folder, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.wacz")
                writer.add(record(i, url, html.encode("utf-8", "surrogatepass"), refers_to), i)
                if writer.size >= archive_bytes:
                    made.append(writer.close())
                    writer = None
        if writer is not None:
            made.append(writer.close())
        yield pa.RecordBatch.from_arrays([pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())], ["archive", "records", "bytes"])

    return stored(keyed.select("page_id", "url", "html", "refers_to").mapInArrow(frugal(run), "archive string, records long, bytes long"), "archives")


def _open(cache: dict, archive: str):
    if archive not in cache:
        cache.clear()  # one archive is open at a time
        files, path = fs.FileSystem.from_uri(archive)
        f = files.open_input_file(path)
        members = directory(f, f.size())
        cache[archive] = f, members
    return cache[archive]


def locate(archives: DataFrame, archives_per_task: int = 4) -> DataFrame:
    """archive, start, length of every record, from the index members; start counts from the archive's begin.

    Archives are dealt to tasks by their number, as the table that names them is small.
    """

    def run(batches):
        cache: dict = {}
        for b in batches:
            for archive in b.column(0).to_pylist():
                f, members = _open(cache, archive)
                at, index = data_start(f, members[DATA]), members[INDEX]
                lines = [json.loads(x) for x in read_range(f, data_start(f, index), index.size).splitlines()]
                for i in range(0, len(lines), 5000):
                    some = lines[i : i + 5000]
                    yield pa.RecordBatch.from_arrays([pa.array([archive] * len(some), pa.string()), pa.array([at + x["offset"] for x in some], pa.int64()), pa.array([x["length"] for x in some], pa.int64())], ["archive", "start", "length"])

    tasks = max(1, -(-archives.count() // archives_per_task))
    return archives.select("archive").repartition(tasks, "archive").mapInArrow(frugal(run), "archive string, start long, length long")


def read_records(archives: DataFrame, with_payload: bool = False, ranges_at_once: int = 2000, task_bytes: int = 4 << 20) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and url, payload) of every record.

    Records' ranges, not archives, are dealt to tasks, in runs of neighbours of about task_bytes; there is
    a task for each task_bytes of all archives, as the bytes to be read, not those shuffled, make the work.
    """
    tasks = 1 + (archives.agg(F.sum("bytes")).first()[0] or 0) // task_bytes
    spots = locate(archives).withColumn("run", F.floor(F.col("start") / task_bytes))
    spots = spots.repartition(int(tasks), "archive", "run").sortWithinPartitions("archive", "start")

    def run(batches):
        cache: dict = {}
        for b in batches:
            cols = b.to_pydict()
            for i in range(0, b.num_rows, ranges_at_once):
                out = []
                for archive, start, length in zip(*(cols[k][i : i + ranges_at_once] for k in ("archive", "start", "length"))):
                    f, _ = _open(cache, archive)
                    out.append(parse(zlib.decompress(read_range(f, start, length), 31)))
                get = lambda k, t: pa.array([x[k] for x in out], t)
                arrays = [get("page_id", pa.int64()), get("payload_bytes", pa.int64()), get("payload_digest", pa.string()), get("record_type", pa.string()), get("refers_to", pa.int64())]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                if with_payload:
                    arrays, names = [*arrays, get("url", pa.string()), get("payload", pa.binary())], [*names, "url", "payload"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    return spots.select("archive", "start", "length").mapInArrow(frugal(run), schema)
