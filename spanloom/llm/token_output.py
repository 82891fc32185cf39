"""3. Token ids of a corpus in a binary format, and back: static range asymmetric numeral system.

Documents are dealt over the tasks by ranges of doc_id. A task tokenises its range in order and writes
segments, rows of a Parquet table: where the segment stands, its index (doc_ids, n_tokens) and the coded ids
(``rans``). Blocks inside a segment decode independently of each other, segments of each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, rans, tokens

#: A segment ends with the document that brings it to so many ids.
SEGMENT = 1 << 20
SCHEMA = "chunk int, segment int, n_ids long, doc_ids array<long>, n_tokens array<long>, ids binary"
_INDEX = pa.schema([("chunk", pa.int32()), ("segment", pa.int32()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("ids", pa.binary())])


def _encode(path: str, spaced: bool, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool, chunk, segment = tokens.tokenizer(path, spaced), TaskContext.get().partitionId(), 0
    held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        docs = pa.concat_arrays([x[0] for x in held])
        ids, counts = (np.concatenate([x[k] for x in held]) for k in (1, 2))
        made = pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip([chunk, segment, len(ids), docs.to_pylist(), counts.tolist(), rans.encode(ids)], _INDEX, strict=True)], schema=_INDEX)
        held.clear()
        return made

    for batch in batches:
        docs = batch.column("doc_id")
        for a, ids, counts in tool.encode(batch.column("text")):
            ids, counts = tokens.with_end(ids, counts, end)
            held.append((docs.slice(a, len(counts)), ids, counts))
            if sum(len(x[1]) for x in held) >= SEGMENT:
                yield flush()
                segment += 1
    if held:
        yield flush()


def write(docs: DataFrame, path: str, vocabulary: str, *, spaced: bool = True, end: int = 0) -> None:
    """Encodes the texts of ``docs`` (doc_id, text; other columns are left out), each followed by the id ``end``, in ascending doc_id order.

    A null text is an empty one. Rows of one doc_id come in the order of their texts, nulls first; a null doc_id comes before all others.
    A text of any length is in one segment. No rows make an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    common.in_order(rows).mapInArrow(lambda batches: _encode(vocabulary, spaced, end, batches), SCHEMA).write.option("compression", "uncompressed").parquet(path)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = rans.decode(batch.column("ids")[i].as_py())
            counts = np.array(batch.column("n_tokens")[i].as_py(), np.int64)
            if counts.sum() != len(ids):
                raise ValueError("a damaged segment: its index doesn't fit its ids")
            ends = np.cumsum(counts)
            starts = ends - counts
            crcs = [zlib.crc32(ids[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
            at = batch.column("start")[i].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[i].values, pa.array(starts + at), pa.array(counts), pa.array(crcs, pa.int64()), pa.LargeListArray.from_arrays(pa.array(np.append(starts, ends[-1:])), pa.array(ids)).cast(pa.list_(pa.int64()))], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _decode(batches):
        yield batch.select(["doc_id", "start", "n_tokens", "ids_crc32"])


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The segments with ``start``, how many ids stand before each. The one window without a key has a row for each range of documents."""
    segments = spark.read.schema(SCHEMA).parquet(path)
    totals = segments.groupBy("chunk").agg(F.sum("n_ids").alias("total"))
    up_to = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("chunk", F.coalesce(F.sum("total").over(up_to), F.lit(0)).alias("before"))
    inside = Window.partitionBy("chunk").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    starts = segments.select("chunk", "segment", "n_ids").withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)))
    starts = starts.join(totals, "chunk").select("chunk", "segment", (F.col("before") + F.col("inside")).alias("start"))
    return segments.join(starts, ["chunk", "segment"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and ids of each document, decoded from the files: as many rows as were written, null doc_ids and repeated rows as they were. No documents give no rows; a damaged segment raises ValueError."""
    return _placed(spark, path).select("doc_ids", "n_tokens", "ids", "start").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """As read(), without the ids."""
    return _placed(spark, path).select("doc_ids", "n_tokens", "ids", "start").mapInArrow(_digests, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    with common.scratch(spark) as scratch:
        path = scratch.path("tokens")
        write(common.load(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
        scratch.keep(path)
        return digests(spark, path)
