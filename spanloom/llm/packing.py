"""6. Hierarchical packing of documents into sequences of several context sizes.

Each task tokenises and packs its own rows, a pool of some documents at a time, so nothing is shuffled:

* a document's whole windows of the longest size are sequences of their own;
* what is left of it goes to the shortest tier that holds it;
* from the longest tier down, each remainder opens a window of its tier's size; the gap takes the longest
  shorter remainders that fit whole, then the front of one more, cut to fill the window exactly;
* a window that runs out of remainders waits for the next pool; at a task's end it is cut into windows of the
  tiers' sizes, and only the last, shorter than the shortest tier, needs padding;
* a pool's sequences, longest first, are dealt out and back over its step groups, so that groups hold equal
  numbers of ids and of each size.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, token_output, tokens

TIERS = (256, 512, 1024, 2048)
#: Ids in a pool, at least, and about as many in a step group.
POOL, STEP = 1 << 20, 1 << 16

Piece = tuple[int, int, int]  # document, start, length


class Remainders:
    """Pieces by length, any of which can be taken out by the longest length up to a limit."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.by: dict[int, list[Piece]] = {}

    def add(self, piece: Piece) -> None:
        if piece[2] not in self.by:
            self.by[piece[2]] = []
            insort(self.lengths, piece[2])
        self.by[piece[2]].append(piece)

    def _take(self, at: int) -> Piece:
        length = self.lengths[at]
        piece = self.by[length].pop()
        if not self.by[length]:
            del self.by[length], self.lengths[at]
        return piece

    def longest(self, most: int) -> Piece | None:
        at = bisect_right(self.lengths, most) - 1
        return self._take(at) if at >= 0 else None

    def shortest(self) -> Piece | None:
        return self._take(0) if self.lengths else None

    def any_over(self, length: int) -> bool:
        return bisect_left(self.lengths, length + 1) < len(self.lengths)


def pack(pieces: list[Piece], tiers: tuple[int, ...]) -> tuple[list[list[Piece]], list[Piece]]:
    """Full sequences, each of a tier's size, and the pieces of the one window that stayed open."""
    full: list[list[Piece]] = []
    left = Remainders()
    top = tiers[-1]
    for doc, start, length in pieces:
        while length >= top:
            full.append([(doc, start, top)])
            start, length = start + top, length - top
        if length:
            left.add((doc, start, length))
    for tier, below in zip(tiers[::-1], [*tiers[-2::-1], 0], strict=True):
        while left.any_over(below):
            window, gap = [], tier
            while gap:
                piece = left.longest(gap)
                if piece is None:
                    piece = left.shortest()
                    if piece is None:
                        return full, window
                    doc, start, length = piece
                    left.add((doc, start + gap, length - gap))
                    piece = (doc, start, gap)
                window.append(piece)
                gap -= piece[2]
            full.append(window)
    return full, []


def cut(window: list[Piece], tiers: tuple[int, ...]) -> list[list[Piece]]:
    """The pieces of an open window as windows of tiers' sizes, and one shorter than the shortest tier."""
    out: list[list[Piece]] = []
    rest = list(window)
    for tier in tiers[::-1]:
        while sum(p[2] for p in rest) >= tier:
            now, gap = [], tier
            while gap:
                doc, start, length = rest.pop(0)
                take = min(gap, length)
                now.append((doc, start, take))
                gap -= take
                if take < length:
                    rest.insert(0, (doc, start + take, length - take))
            out.append(now)
    return [*out, rest] if rest else out


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64()), ("step_group", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


class _Pool:
    """Documents that wait to be packed, with their ids."""

    def __init__(self, tiers: tuple[int, ...], step: int, with_ids: bool):
        self.tiers, self.step, self.with_ids = tiers, step, with_ids
        self.docs: dict[int, tuple[int | None, np.ndarray]] = {}
        self.pieces: list[Piece] = []
        self.fields = _FIELDS + ([("ids", pa.list_(pa.int64()))] if with_ids else [])
        self.seen = self.held = self.groups = 0
        self.next = TaskContext.get().partitionId() << 32

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs[self.seen] = (doc_id, ids)
        self.pieces.append((self.seen, 0, len(ids)))
        self.seen += 1
        self.held += len(ids)

    def flush(self, last: bool) -> pa.RecordBatch:
        full, window = pack(self.pieces, self.tiers)
        if last:
            full += cut(window, self.tiers)
            window = []
        full.sort(key=lambda w: -sum(p[2] for p in w))
        groups = max(1, sum(p[2] for w in full for p in w) // self.step)
        rows: list[list] = [[] for _ in self.fields]
        base = self.next + self.groups
        for k, w in enumerate(full):
            turn, place = divmod(k, groups)
            size, offset = sum(p[2] for p in w), 0
            for doc, start, length in w:
                doc_id, ids = self.docs[doc]
                some = ids[start : start + length]
                for column, value in zip(rows, (doc_id, start, length, zlib.crc32(some), len(ids), self.next + k, offset, size, base + (place if turn % 2 == 0 else groups - 1 - place), *([some] if self.with_ids else [])), strict=True):
                    column.append(value)
                offset += length
        self.next += len(full)
        self.groups += groups - len(full)
        kept = {p[0] for p in window}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}
        self.pieces, self.held = window, sum(p[2] for p in window)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(rows, self.fields, strict=True)], schema=pa.schema(self.fields))


def _pack(path: str, end: int, tiers: tuple[int, ...], step: int, with_ids: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tool, pool = tokens.tokenizer(path, False), _Pool(tiers, step, with_ids)
    for batch in batches:
        docs = batch.column("doc_id").to_pylist()
        for a, ids, counts in tool.encode(batch.column("text")):
            ids, counts = tokens.with_end(ids.astype("<u4"), counts, end)
            for k, one in enumerate(np.split(ids, np.cumsum(counts)[:-1])):
                pool.add(docs[a + k], one)
            if pool.held >= POOL:
                yield pool.flush(False)
    if pool.pieces:
        yield pool.flush(True)


def packed(docs: DataFrame, vocabulary: str, *, end: int = 1, tiers: tuple[int, ...] = TIERS, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """One row for each piece of each text (then the id ``end``) of ``docs`` (doc_id, text; other columns are left out).

    A null text is an empty one: the end id alone. Rows of one doc_id, null too, are documents of their own. A text of
    any length is cut into as many pieces as it takes. No rows give none.
    sequence_tokens is how many ids the piece's sequence holds; with_ids adds the piece's ids.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lambda batches: _pack(vocabulary, end, tiers, step, with_ids, batches), SCHEMA + ", ids array<long>" * with_ids)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(common.load(spark, sf_dir, "documents"), token_output.vocabulary("word_bpe_49k.json"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows of docs."""
    return packed(docs, token_output.vocabulary("word_bpe_49k.json"))
