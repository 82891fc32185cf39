"""8. WARC archives: written by tasks, one gzip member a record, and read back by byte ranges.

A reading task looks for gzip's magic bytes from its range's start, takes a candidate whose decoded bytes
begin with a WARC header and which decodes to its end, and then follows member by member. It owns the records
that start inside its range, and reads past the range's end to finish the last of them.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of an archive after which a task begins another, and of the ranges in which archives are read.
ARCHIVE_BYTES, RANGE_BYTES = 256 << 20, 4 << 20
#: Reading tasks at most; beyond, each reads several ranges.
MOST_TASKS = 100_000
_CHUNK = 1 << 18
_MAGIC = b"\x1f\x8b\x08"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "path string, bytes long, records long"
READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _files(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """Whatever store the shared folder is in: a plain path or a URI."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(text: str | None) -> str:
    """A header's value: control characters, of which none may stand there, as spaces."""
    return "".join(" " if ord(c) < 32 or ord(c) == 127 else c for c in text or "")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response, or a revisit of the page refers_to, which has the headers of the HTTP message alone."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {_line(url)}"] * (url is not None) + [f"WARC-Payload-Digest: sha1:{digest}"]
    lines += [f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {_PROFILE}"] * revisit
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(path: str, most: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    store, folder = _files(path)
    store.create_dir(folder, recursive=True)
    # a task that is run again writes files of its own; only those that a finished task names are read
    attempt, part = uuid.uuid4().hex, 0
    out, name, size, records = None, "", 0, 0
    done = []

    def close() -> None:
        out.close()
        done.append((f"{path}/{name}", size, records))

    for batch in batches:
        columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
        for i in range(batch.num_rows):
            page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
            if out is None:
                name, size, records = f"{TaskContext.get().partitionId():06d}-{part:04d}-{attempt}.warc.gz", 0, 0
                out = store.open_output_stream(f"{folder}/{name}", compression=None)
                part += 1
            member = gzip.compress(record(page_id, url, html.encode(), digest, refers_to), 6, mtime=0)
            out.write(member)
            size, records = size + len(member), records + 1
            if size >= most:
                close()
                out = None
    if out is not None:
        close()
    yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexadecimal: F.Column) -> F.Column:
    """A SHA-1 of 40 hex digits as 32 base32 digits: each five of the former are four of the latter."""
    digit = lambda v, by: F.substring(F.lit(_BASE32), F.shiftright(v, by).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1))
    five = lambda i: F.conv(F.substring(hexadecimal, i * 5 + 1, F.lit(5)), 16, 10).cast("long")
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.concat(*(digit(five(i), by) for by in (15, 10, 5, 0)))), "")


def write(pages: DataFrame, path: str, *, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html; other columns are left out) and returns path, bytes and records of the archives.

    The payload is the html in UTF-8, null: empty. Of records with equal payloads of at least ``least_bytes``
    those with the largest page_id are responses and the others revisit it; a null page_id is smaller than any. Rows that
    repeat, and others that share the largest page_id, are all responses. An html of any length is one record; no rows
    write no archive.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha1", F.sha1(F.encode("html", "UTF-8"))).withColumn("digest", base32(F.col("sha1"))).drop("sha1")
    same = rows.filter(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n"))
    same = same.filter(F.col("n") > 1).select("digest", "keeper")
    rows = rows.join(same, "digest", "left")
    rows = rows.withColumn("refers_to", F.when((F.octet_length("html") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")))
    written = rows.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(lambda batches: _write(path, archive_bytes, batches), WRITTEN)
    with common.scratch(pages.sparkSession) as scratch:
        archives = scratch.table(written, "archives")
        scratch.keep(archives)
        return archives


class _Source:
    """Bytes of a file from any place on, a chunk at a time."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def chunk(self, at: int, least: int = 1) -> bytes:
        """The bytes from ``at`` on, ``least`` of them if the file has them; empty at its end."""
        if not (self.at <= at and at + least <= self.at + len(self.data)) and at < self.size:
            self.data, self.at = self.file.read_at(min(max(_CHUNK, least), self.size - at), at), at
        return self.data[at - self.at :] if at < self.size else b""


def _member(source: _Source, at: int) -> tuple[bytes, int] | None:
    """What the gzip member at ``at`` decodes to and where it ends; None if none starts there or it is no record."""
    tool, out, n = zlib.decompressobj(31), [], 0
    try:
        while not tool.eof:
            data = source.chunk(at)
            if not data:
                return None
            out.append(tool.decompress(data))
            n += len(out[-1])
            at += len(data) - len(tool.unused_data)
            if n >= 5 and not out[0].startswith(b"WARC/"[: len(out[0])]):
                return None
    except zlib.error:
        return None
    whole = b"".join(out)
    return (whole, at) if whole.startswith(b"WARC/") else None


def members(source: _Source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the records that start in [start, end)."""
    at, sure = start, start == 0
    while at < min(end, source.size):
        if not sure:
            data = source.chunk(at, 3)
            found = data.find(_MAGIC)
            if found < 0:
                at += max(1, len(data) - 2)
                continue
            at += found
            if at >= end:
                return
        got = _member(source, at)
        # behind a record there is another or the file's end; anything else was found inside a record
        if got is None or (got[1] < source.size and source.chunk(got[1], 3)[:3] != _MAGIC):
            if sure:
                raise ValueError(f"no WARC record at byte {at}")
            at += 1
            continue
        yield at, got[0]
        at, sure = got[1], True


def _page(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def parse(raw: bytes) -> tuple:
    """A row of READ from a record; one whose payload doesn't fit its digest raises ValueError."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']}: its payload doesn't fit its digest")
    return _page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, _page(fields.get("WARC-Refers-To")), length, digest, payload if kind == "response" else None


_TYPES = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary())
_NAMES = [x.split()[0] for x in READ.split(", ")]


def _read(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_TYPES[: 6 + payloads])], names=_NAMES[: 6 + payloads])

    for batch in batches:
        for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end")), strict=True):
            store, name = _files(path)
            with store.open_input_file(name) as file:
                rows, held = [], 0
                for _, raw in members(_Source(file, file.size()), start, end):
                    rows.append(parse(raw)[: 6 + payloads])
                    held += len(raw) if payloads else 1000
                    if held > 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if rows:
                    yield made(rows)


def read(archives: DataFrame, *, range_bytes: int = RANGE_BYTES, payloads: bool = True) -> DataFrame:
    """The records of archives (path, bytes), by ranges of so many bytes, each a task of its own. A revisit has no payload of its own.

    Null page_ids and urls come back as they were, repeated rows as often, payloads of any length as a whole; an
    archive without records, or no archives, gives no rows. A record whose payload doesn't fit its digest raises ValueError.
    """
    counts = F.greatest(F.ceil(F.col("bytes") / range_bytes), F.lit(1))
    tasks = archives.agg(F.coalesce(F.sum(counts), F.lit(0))).first()[0]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = archives.select("path", starts.alias("start")).withColumn("end", F.col("start") + range_bytes)
    schema = READ if payloads else READ.removesuffix(", payload binary")
    # a number of its own: else adaptive execution would put these few small rows into one task
    return ranges.repartition(min(max(1, tasks), MOST_TASKS)).mapInArrow(lambda batches: _read(payloads, batches), schema)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.scratch(spark) as scratch:
        path = scratch.path("warc")
        archives = write(common.load(spark, sf_dir, "pages"), path)
        scratch.keep(path)
    return read(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS keeper FROM p),
v AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(5 * i + 1 AS INT), 5))::BIGINT) AS fives FROM d)
SELECT page_id, payload_bytes,
  list_reduce(list_transform(fives, lambda x: list_reduce(list_transform([15, 10, 5, 0], lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((x >> b) & 31) + 1 AS INT), 1)), lambda a, c: a || c)), lambda a, c: a || c) AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keeper THEN NULL ELSE keeper END AS refers_to
FROM v
"""
