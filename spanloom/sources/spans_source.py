"""Documents with spans as a data source of Spark: ``spark.read.format("spans").load(path)``, and to write and stream.

Files hold a document a line. They are read by byte ranges, a task for each, and a line belongs to the range in which
it begins. What can't be used is reported beside what can: a row is never lost, and never fails the job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

#: Bytes of a range, and of the lines that are handed on together.
RANGE_BYTES, _TOGETHER = 64 << 20, 4 << 20
SPAN = "struct<start:bigint,end:bigint,label:string,value:string,category:string,sensitivity:string,note:string>"
SCHEMA = f"doc_id string, text string, spans array<{SPAN}>, items array<{SPAN}>, sensitivity_spans array<{SPAN}>, errors array<struct<field:string,at:int,reason:string>>, path string, offset bigint"

_TEXTS = ("label", "value", "category", "sensitivity", "note")
_ALIASES = {"label": "entity_type", "value": "entity_value"}
_SPAN_TYPE = pa.struct([("start", pa.int64()), ("end", pa.int64()), *((c, pa.string()) for c in _TEXTS)])
_ERROR_TYPE = pa.struct([("field", pa.string()), ("at", pa.int32()), ("reason", pa.string())])
_FIELDS = ("spans", "items", "sensitivity_spans")
_ARROW = pa.schema([("doc_id", pa.string()), ("text", pa.string()), *((f, pa.list_(_SPAN_TYPE)) for f in _FIELDS), ("errors", pa.list_(_ERROR_TYPE)), ("path", pa.string()), ("offset", pa.int64())])


def _whole(value: object) -> int | None:
    """A JSON integer of 64 bits; true and 1.0 are none."""
    return value if type(value) is int and -(2**63) <= value < 2**63 else None


def span_of(span: object, text: str | None) -> tuple[dict | None, str | None]:
    """A span in the one form, and why it can't be used, if so. Offsets fall back pairwise to start_position and end_position."""
    if not isinstance(span, dict):
        return None, "span is not an object"
    start, end = _whole(span.get("start")), _whole(span.get("end"))
    if start is None or end is None:
        start, end = _whole(span.get("start_position")), _whole(span.get("end_position"))
    if start is None or end is None:
        return None, "start/end are not ints"
    if text is None or start < 0 or end <= start or end > len(text):
        return None, "invalid bounds"
    found = {"start": start, "end": end}
    for c in _TEXTS:
        value = span.get(c)
        if value is None and c in _ALIASES:
            value = span.get(_ALIASES[c])
        found[c] = value if isinstance(value, str) else None
    if found["label"] is None:
        return None, "label is not a string"
    if not found["label"].strip():
        return None, "label is empty"
    return found, None


def document_of(line: str) -> dict | None:
    """A line's document with its errors; None for a blank line."""
    if not line.strip():
        return None
    row: dict = {"doc_id": None, "text": None, **dict.fromkeys(_FIELDS), "errors": []}
    report = lambda field, at, reason: row["errors"].append({"field": field, "at": at, "reason": reason})
    try:
        found = json.loads(line)
    except ValueError:
        report(None, None, "not JSON")
        return row
    if not isinstance(found, dict):
        report(None, None, "row is not an object")
        return row
    text = found.get("text") if found.get("text") is not None else found.get("full_text")
    row["doc_id"] = None if found.get("doc_id") is None else str(found["doc_id"])
    row["text"] = text if isinstance(text, str) else None
    if row["text"] is None:
        report("text", None, "row text is not a string")
    for field in _FIELDS:
        spans = found.get(field)
        if spans is None:
            continue
        if not isinstance(spans, list):
            report(field, None, "spans is not a list")
            continue
        row[field] = []
        for at, span in enumerate(spans):
            good, reason = span_of(span, row["text"])
            if good is not None:
                row[field].append(good)
            elif row["text"] is not None or reason != "invalid bounds":
                report(field, at, reason)
    return row


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int, int]]:
    """(path, bytes, time) of the files at or below a path, in the order of their names; those whose names begin with . or _ are left out."""
    from pyarrow import fs

    store, place = _store(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(place, recursive=True)) if f.is_file and f.base_name[0] not in "._"]
    return sorted((f.path, f.size, f.mtime_ns or 0) for f in found)


@dataclass
class Range(InputPartition):
    """Lines that begin in [start, end) of a file."""

    path: str
    start: int
    end: int


def _ranges(files: list[tuple[str, int, int]], size: int) -> list[Range]:
    return [Range(path, at, min(at + size, total)) for path, total, _ in files for at in range(0, total, size)]


def lines_of(stream: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in [start, end)."""
    at = max(0, start - 1)
    stream.seek(at)
    rest, done = b"", start == 0
    while True:
        block = stream.read(1 << 20)
        lines = (rest + block).split(b"\n")
        rest = lines.pop() if block else b""
        for line in lines:
            if done:
                if at >= end:
                    return
                yield at, line
            # the byte before the range ends the line before it
            done = True
            at += len(line) + 1
        if not block:
            return


def _read(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    store, _ = _store(root)
    rows, size = [], 0
    with store.open_input_file(part.path) as stream:
        for offset, line in lines_of(stream, part.start, part.end):
            row = document_of(line.decode("utf-8", "replace"))
            if row is None:
                continue
            rows.append(row | {"path": part.path, "offset": offset})
            size += len(line)
            if size >= _TOGETHER:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def partitions(self) -> list[Range]:
        return _ranges(_files(self.path), self.range_bytes) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    """Files by time and name; an offset is the last one's."""

    def __init__(self, path: str, range_bytes: int):
        self.path, self.range_bytes = path, range_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "name": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = _files(self.path)
        return max(({"time": t, "name": p} for p, _, t in files), key=lambda o: (o["time"], o["name"]), default=self.initialOffset())

    def partitions(self, start: dict, end: dict) -> list[Range]:
        among = [f for f in _files(self.path) if (start["time"], start["name"]) < (f[2], f[0]) <= (end["time"], end["name"])]
        return _ranges(among, self.range_bytes)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _read(self.path, partition)


@dataclass
class _Written(WriterCommitMessage):
    path: str | None


class _Writer(DataSourceArrowWriter):
    """A file for each task; names hold what makes the write's files its own, and those of failed tasks are deleted."""

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.run = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        store, place = _store(self.path)
        task = TaskContext.get()
        name = f"{place.rstrip('/')}/_part-{task.partitionId():05}-{self.run}-{task.attemptNumber()}"
        store.create_dir(place, recursive=True)
        with store.open_output_stream(name) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    kept = {k: v for k, v in row.items() if v is not None and k not in ("errors", "path", "offset")}
                    for field in _FIELDS:
                        if field in kept:
                            kept[field] = [{k: v for k, v in span.items() if v is not None} for span in kept[field]]
                    out.write(json.dumps(kept, ensure_ascii=False).encode("utf-8", "surrogatepass") + b"\n")
        return _Written(name)

    def commit(self, messages: list[_Written | None]) -> None:
        """Old files go, where they are to be replaced, and new ones get the names that readers take."""
        store, place = _store(self.path)
        old = [p for p, _, _ in _files(self.path)] if self.overwrite else []
        for message in messages:
            if message is not None and message.path:
                folder, name = message.path.rsplit("/", 1)
                store.move(message.path, f"{folder}/{name[1:]}.jsonl")
        for path in old:
            store.delete_file(path)

    def abort(self, messages: list[_Written | None]) -> None:
        store, _ = _store(self.path)
        for message in messages:
            if message is not None and message.path:
                store.delete_file(message.path)


class SpanSource(DataSource):
    """Options: path, and range_bytes, the bytes of a file that a task reads."""

    @classmethod
    def name(cls) -> str:
        return "spans"

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("spans: give a path")
        return self.options["path"], int(self.options.get("range_bytes", RANGE_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(*self._where())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(*self._where())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._where()[0], overwrite)


def register(spark: SparkSession) -> SparkSession:
    """Makes the format known to a session. Paths are those that pyarrow opens: local ones, S3, GCS, HDFS with libhdfs."""
    spark.dataSource.register(SpanSource)
    return spark
