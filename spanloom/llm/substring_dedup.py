"""2. Repeated passages: seeds are winnowed anchors, extended both ways to maximal repeats.

A window of LENGTH words holds LENGTH - K + 1 runs of K words; that of the least hash (the first of equal ones)
is its anchor. Equal windows have equal anchors at equal places, so a repeat of LENGTH words has a common anchor.
Windows in a row with one anchor are its reach: the anchor's extension both ways.

1. Documents are joined on anchors that occur more than once.
2. Anchors with equal reaches are one class. In a class of two or more, all windows of the reach repeat.
3. Where an anchor has several classes, one occurrence of each class gives its windows, to be compared one by
   one: these are the ends of matches, where the extension stops short.

Repeats that overlap or touch make a maximal one. Copies cost no more than one row for each anchor, never a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, words

#: Words of a window, and of an anchor.
LENGTH, K = 35, 8
_U = np.uint64


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` values in a row stands, the first of equal ones."""
    at = np.arange(len(values))
    step = 1
    while step < width:
        by = min(step, width - step)
        a, b = at[: len(at) - by], at[by:]
        at = np.where(values[b] < values[a], b, a)
        step += by
    return at


def _windows(w: words.Words, length: int) -> np.ndarray:
    """First words of all windows."""
    start = np.arange(max(0, len(w.starts) - length + 1))
    return start[start + length <= w.last()[: len(start)]]


def _anchored(w: words.Words, length: int, k: int) -> tuple[np.ndarray, ...]:
    """For each reach: its anchor's hash, its own hash, its first window and how many windows it has."""
    start = _windows(w, length)
    if not len(start):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    sums = words.sequences(w.hashes())
    run = np.arange(len(w.starts) - k + 1)
    seeds = words.spans(sums, run, run + k)
    anchor = _least(seeds, length - k + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(start)))
    first = start[at]
    return seeds[anchor[at]], words.mix(words.spans(sums, first, first + count - 1 + length) + (anchor[at] - first).astype(np.uint64)), first, count


def _local(w: words.Words, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of each word, and its place there."""
    text = np.searchsorted(w.first, places, side="right") - 1
    return text, places - w.first[text]


def _anchors(length: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [batch.column(c) for c in ("k1", "k2")]
        for a, _, w in words.groups(batch.column("text")):
            anchor, reach, first, count = _anchored(w, length, k)
            text, place = _local(w, first)
            rows = pa.array(text + a)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(reach.view(np.int64)), *(c.take(rows) for c in keys), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32))], names=["anchor", "reach", "k1", "k2", "first", "count"])


def _compared(length: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of the reaches named with each text."""
    for batch in batches:
        named = batch.column("named")
        keys = [batch.column(c) for c in ("k1", "k2")]
        for a, b, w in words.groups(batch.column("text")):
            sums = words.sequences(w.hashes())
            some = named.slice(a, b - a)
            row = np.repeat(np.arange(b - a), np.diff(some.offsets.to_numpy()))
            each = some.flatten()
            anchor, first, count, n = (each.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "first", "count", "n"))
            begin = w.first[row] + first
            again = np.repeat(np.arange(len(row)), count)
            start = begin[again] + np.arange(len(again)) - np.repeat(np.cumsum(count.astype(np.int64)) - count, count)
            # another text under the same key: its own row of keys has the right one
            good = start + length <= w.first[row + 1][again]
            again, start = again[good], start[good]
            rows = pa.array(row[again] + a)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor[again]), pa.array(words.spans(sums, start, start + length).view(np.int64)), pa.array(n[again].astype(np.int64)), *(c.take(rows) for c in keys), pa.array((start - w.first[row[again]]).astype(np.int32))],
                names=["anchor", "window", "n", "k1", "k2", "first"],
            )


def _ranges(pairs: list | None, n: int, length: int) -> list[tuple[int, int]]:
    """[start, end) of the maximal repeats, from (first window, windows) in any order."""
    out: list[list[int]] = []
    for first, count in sorted((p["first"], p["count"]) for p in pairs or ()):
        end = min(n, first + count - 1 + length)
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [(s, e) for s, e in out]


def _cut(length: int, at_text: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """at_text: which of a row's fields is its text."""
    for batch in batches:
        n_words, removed, texts, digests, ranges = [], [], [], [], []
        for text, found in zip(batch.column("row").field(at_text).cast(pa.string()), batch.column("found"), strict=True):
            whole = (text.as_py() or "").encode()
            own = whole.split()
            spans = _ranges(found.as_py(), len(own), length)
            gone = sum(e - s for s, e in spans)
            kept, at = [], 0
            for s, e in [*spans, (len(own), len(own))]:
                kept += own[at:s]
                at = e
            joined = b" ".join(kept)
            n_words.append(len(own))
            removed.append(gone)
            texts.append(joined.decode() if gone else text.as_py())
            digests.append(hashlib.sha256(joined).hexdigest())
            ranges.append([{"start": s, "end": e} for s, e in spans])
        part = pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string()), pa.array(digests, pa.string()), pa.array(ranges, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["n_words", "n_removed", "text", "sha256", "repeats"])
        yield pa.RecordBatch.from_arrays([batch.column("row"), part], names=["row", "cut"])


def repeats(docs: DataFrame, scratch: common.Scratch, *, length: int = LENGTH, k: int = K) -> DataFrame:
    """k1, k2 (the row, see common.row_key) and found: (first window, windows in a row) whose words stand elsewhere too, of each row that has any.

    ``docs`` has doc_id and text; a null text has no words. Rows that repeat are found to repeat each other, and have
    one row of the result, as long as one text. What is counted by anchor or window is written before it is joined,
    so that Spark can split the joins of a passage that very many rows hold.
    """
    text = F.col("text").cast("string")
    rows = docs.select(*common.row_key(F.col("doc_id"), text), text.alias("text"))
    anchors = rows.mapInArrow(lambda b: _anchors(length, k, b), "anchor long, reach long, k1 long, k2 long, first int, count int")
    anchors = scratch.table(anchors, "anchors")
    count = F.count(F.lit(1))
    often = scratch.table(anchors.groupBy("anchor").agg(count.alias("n")).filter("n > 1").select("anchor"), "often")
    joined = scratch.table(anchors.join(often, "anchor", "left_semi"), "joined")
    scratch.drop(anchors, often)
    one = F.min(F.struct("k1", "k2", "first", "count"))
    classes = scratch.table(joined.groupBy("anchor", "reach").agg(count.alias("n"), one.alias("one")), "classes")
    whole = joined.join(classes.filter("n > 1").select("anchor", "reach"), ["anchor", "reach"], "left_semi").select("k1", "k2", "first", "count")

    mixed = scratch.table(classes.groupBy("anchor").agg(count.alias("classes")).filter("classes > 1").select("anchor"), "mixed")
    named = classes.join(mixed, "anchor", "left_semi").select("one.k1", "one.k2", F.struct("anchor", "one.first", "one.count", "n").alias("each"))
    named = scratch.table(named.groupBy("k1", "k2").agg(F.collect_list("each").alias("named")), "named")
    # rows that repeat each give the windows of a class that already has several occurrences: that changes no verdict
    windows = rows.join(named, ["k1", "k2"]).mapInArrow(lambda b: _compared(length, b), "anchor long, window long, n long, k1 long, k2 long, first int")
    windows = scratch.table(windows, "windows")
    scratch.drop(named, mixed)
    twice = scratch.table(windows.groupBy("anchor", "window").agg(F.sum("n").alias("total")).filter("total > 1").select("anchor", "window"), "twice")
    ends = windows.filter("n = 1").join(twice, ["anchor", "window"], "left_semi").select("k1", "k2", "first", F.lit(1).alias("count"))
    found = scratch.table(whole.union(ends).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "count")).alias("found")), "found")
    scratch.drop(joined, classes, windows, twice)
    return found


def without_repeats(docs: DataFrame, *, length: int = LENGTH, k: int = K) -> DataFrame:
    """row (docs' columns) and cut: n_words, n_removed, text, sha256 of the words kept, repeats (word ranges).

    Every word is removed that a window of ``length`` words covers whose words also start anywhere else in ``docs``.
    The text is the words kept, one space between them; it stays as it was, null too, if none was removed. Texts of
    any length are cut as a whole; rows that repeat are cut alike; no rows give none. The result reads from a table
    in the shared folder.
    """
    with common.scratch(docs.sparkSession) as scratch:
        found = repeats(docs, scratch, length=length, k=k)
        scratch.keep(found)
    found = found.toDF("_k1", "_k2", "_found")
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text").cast("string"))
    # the text goes along once, in its row
    rows = docs.select(k1.alias("_k1"), k2.alias("_k2"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    rows = rows.join(found, ["_k1", "_k2"], "left")
    row_type = rows.schema["row"].dataType.simpleString()
    out = f"row {row_type}, cut struct<n_words: bigint, n_removed: bigint, text: string, sha256: string, repeats: array<struct<start: bigint, end: bigint>>>"
    at_text = docs.columns.index("text")
    return rows.select("row", F.col("_found").alias("found")).mapInArrow(lambda b: _cut(length, at_text, b), out)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.load(spark, sf_dir, "documents").select("doc_id", "text")
    slim = without_repeats(docs)
    return slim.select("row.doc_id", "cut.n_words", "cut.n_removed", F.col("cut.sha256").alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of docs, without the words that repeat; n_chars counts what is left."""
    cut = without_repeats(docs)
    new = {"text": F.col("cut.text")} | ({"n_chars": F.when(F.col("cut.n_removed") > 0, F.length("cut.text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return cut.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


ORACLE = f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
p AS (SELECT r, unnest(l) AS word, unnest(range(1, len(l) + 1)) AS i FROM w),
k AS (SELECT r, i, l, md5(array_to_string(l[i:i + {LENGTH - 1}], ' ')) AS h FROM (SELECT r, l, unnest(range(1, len(l) - {LENGTH - 2})) AS i FROM w WHERE len(l) >= {LENGTH})),
c AS (SELECT r, i, count(*) OVER (PARTITION BY h) > 1 AS twice FROM k),
m AS (SELECT p.r, p.i, p.word, coalesce(bool_or(twice) OVER (PARTITION BY p.r ORDER BY p.i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW), false) AS gone FROM p LEFT JOIN c ON p.r = c.r AND p.i = c.i),
s AS (SELECT r, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM m GROUP BY r)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN s ON w.r = s.r
"""
