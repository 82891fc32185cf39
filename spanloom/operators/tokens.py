"""Tokens of texts and spans on them, inside the document's row: batches of texts at a time, positions by binary search.

A token is a run of letters, digits and underscores, or another visible character. No token becomes a row unless asked
for. With special tokens a text has one of no characters, (0, 0), before its first and after its last.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags of tokens, and what a special token has for one.
O, B, I, IGNORED = 0, 1, 2, -100  # noqa: E741
#: Bytes of texts that are worked on together.
_GROUP = 1 << 18


@functools.cache
def _ranges() -> tuple[np.ndarray, np.ndarray]:
    """Where kinds of code points begin, and which: 1 for what tokens of several characters consist of, 0 for white space, 2 for others. Made on the driver and sent along."""
    kinds = np.full(sys.maxunicode + 1, 2, np.uint8)
    kinds[[cp for cp in range(sys.maxunicode + 1) if unicodedata.category(chr(cp))[0] in "LN"]] = 1
    kinds[ord("_")] = 1
    kinds[[ord(c) for c in " \t\n\x0b\f\r"]] = 0
    starts = np.flatnonzero(np.concatenate([[True], kinds[1:] != kinds[:-1]]))
    return starts, kinds[starts]


class _Located:
    """The tokens of some texts: s and e are positions in all texts joined, first[t] is text t's first token, base[t] where it starts."""

    def __init__(self, texts: list[str], table: np.ndarray):
        joined = "\n".join(texts) + "\n"
        kind = table[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
        word, lone = kind == 1, kind == 2
        edge = np.zeros(len(kind) + 1, bool)
        edge[1:-1] = word[1:] & word[:-1]
        self.s, self.e = np.flatnonzero((word & ~edge[:-1]) | lone), np.flatnonzero((word & ~edge[1:]) | lone) + 1
        self.base = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.first = np.searchsorted(self.s, self.base)
        self.count = np.diff(self.first)

    def own(self, positions: np.ndarray) -> np.ndarray:
        """Positions of all tokens in their own texts."""
        return positions - np.repeat(self.base[:-1], self.count)

    def _clamped(self, text: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.base[text] + np.clip(at, 0, self.base[text + 1] - self.base[text] - 1)

    def overlapping(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each span the first and last token of its text that overlap it, from 0; the first is past the last where none does."""
        ts = np.searchsorted(self.e, self._clamped(text, start), side="right")
        te = np.searchsorted(self.s, self._clamped(text, end), side="left") - 1
        none = (start >= end) | (ts > te)
        return np.where(none, 0, ts - self.first[text]), np.where(none, -1, te - self.first[text])

    def containing(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By containment: the token that holds the start, else the first from there on; the token that holds the end, else the last up to there."""
        if not len(self.s):
            return np.zeros(len(text), np.int64), np.full(len(text), -1)
        a, b, top = self._clamped(text, start), self._clamped(text, end), len(self.s) - 1
        holds = np.searchsorted(self.s, a, side="right") - 1
        inside = (holds >= self.first[text]) & (self.e[np.clip(holds, 0, top)] > a)
        ts = np.where(inside, holds, np.searchsorted(self.s, a, side="left"))
        holds = np.searchsorted(self.s, b, side="left") - 1
        inside = (holds >= self.first[text]) & (self.e[np.clip(holds, 0, top)] >= b)
        te = np.where(inside, holds, np.searchsorted(self.e, b, side="right") - 1)
        none = (ts > te) | (ts >= self.first[text + 1]) | (te < self.first[text])
        return np.where(none, 0, ts - self.first[text]), np.where(none, -1, te - self.first[text])


def _groups(column: pa.Array, table: np.ndarray) -> Iterator[tuple[int, int, _Located]]:
    """The column's texts some at a time, a null one as an empty one: Python has no more of them at once than _GROUP bytes, or one."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + _GROUP, side="right")))
        yield a, b, _Located([t or "" for t in column.slice(a, b - a).to_pylist()], table)
        a = b


def _joined(parts: list[np.ndarray], kind: type = np.int64) -> np.ndarray:
    return np.concatenate(parts) if parts else np.zeros(0, kind)


def _list(values: np.ndarray, counts: np.ndarray, kind: pa.DataType, gone: np.ndarray | None = None) -> pa.ListArray:
    bounds = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
    return pa.ListArray.from_arrays(bounds, pa.array(values, kind, mask=gone))


def _mapped(kind: str, work, *columns: Column) -> Column:
    """``work`` of whole Arrow columns, with the kinds of code points, as a column."""
    starts, kinds = _ranges()

    def table() -> np.ndarray:
        return np.repeat(kinds, np.diff(np.append(starts, sys.maxunicode + 1)))

    if len(columns) == 1:

        def batches(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
            known = table()
            for column in it:
                yield work(known, column)

        batches.__annotations__ = {"it": Iterator[pa.Array], "return": Iterator[pa.Array]}
    else:

        def batches(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            known = table()
            for several in it:
                yield work(known, *several)

        batches.__annotations__ = {"it": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, kind)(*columns)


def offsets(text: Column, specials: bool = False) -> Column:
    """struct(s, e): arrays of where each token starts and ends; a null text is an empty one."""

    def work(table: np.ndarray, column: pa.Array) -> pa.Array:
        starts, ends, counts = [], [], []
        for _, _, t in _groups(column, table):
            s, e, n = t.own(t.s), t.own(t.e), t.count
            if specials:
                at = np.concatenate([t.first[:-1], t.first[1:]])
                s, e, n = np.insert(s, at, 0), np.insert(e, at, 0), n + 2
            starts.append(s)
            ends.append(e)
            counts.append(n)
        n = _joined(counts)
        return pa.StructArray.from_arrays([_list(_joined(x), n, pa.int64()) for x in (starts, ends)], names=["s", "e"])

    return _mapped("struct<s: array<bigint>, e: array<bigint>>", work, text)


def counted(text: Column) -> Column:
    """How many tokens a text has, special ones left out."""

    def work(table: np.ndarray, column: pa.Array) -> pa.Array:
        return pa.array(_joined([t.count for _, _, t in _groups(column, table)]), pa.int64())

    return _mapped("bigint", work, text)


def listed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, tok, s, e of every token; nothing is shuffled."""
    rows = docs.select(key, offsets(F.col(text)).alias("o")).select(key, F.posexplode(F.arrays_zip("o.s", "o.e")).alias("tok", "t"))
    return rows.select(key, F.col("tok").cast("bigint").alias("tok"), F.col("t.s").alias("s"), F.col("t.e").alias("e"))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values (0 for null), whether they are there, and how many each row has; a null list is an empty one."""
    rows = column.cast(pa.list_(pa.int64()))
    counts = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = rows.flatten()
    return values.fill_null(0).to_numpy(zero_copy_only=False), values.is_valid().to_numpy(zero_copy_only=False), counts


def aligned(text: Column, start: Column, end: Column, containing: bool = False, specials: bool = False) -> Column:
    """struct(ts, te): for arrays of character spans, of each the first and last token that overlap it; or those that hold its ends, with the nearest inside for an end that none holds. Null for a span without tokens or without offsets. specials: tokens are counted with the special one before them."""

    def work(table: np.ndarray, texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        (s, s_set, counts), (e, e_set, _) = _flat(starts), _flat(ends)
        upto = np.concatenate([[0], np.cumsum(counts)])
        found = [], []
        for a, b, t in _groups(texts, table):
            here = slice(upto[a], upto[b])
            of = np.repeat(np.arange(b - a), counts[a:b])
            for part, side in zip(found, (t.containing if containing else t.overlapping)(of, s[here], e[here]), strict=True):
                part.append(side + specials)
        ts, te = (_joined(part) for part in found)
        gone = (ts > te) | ~s_set | ~e_set
        return pa.StructArray.from_arrays([_list(x, counts, pa.int64(), gone) for x in (ts, te)], names=["ts", "te"])

    return _mapped("struct<ts: array<bigint>, te: array<bigint>>", work, text, start, end)


def positions(text: Column, ts: Column, te: Column, specials: bool = False, guarded: bool = True) -> Column:
    """struct(start, end): for arrays of token spans, of each the characters from its first token's start to its last one's end; null where an index is out of range or reversed. guarded: also where an end is a special token."""

    def work(table: np.ndarray, texts: pa.Array, firsts: pa.Array, lasts: pa.Array) -> pa.Array:
        (a, a_set, counts), (b, b_set, _) = _flat(firsts), _flat(lasts)
        upto = np.concatenate([[0], np.cumsum(counts)])
        starts, ends, wrong = [], [], []
        for lo, hi, t in _groups(texts, table):
            here = slice(upto[lo], upto[hi])
            of = np.repeat(np.arange(hi - lo), counts[lo:hi])
            n = t.count[of]
            s, e = np.append(t.own(t.s), 0), np.append(t.own(t.e), 0)
            x, y = a[here] - specials, b[here] - specials
            low, high = (-1, n) if specials else (0, n - 1)
            edge = lambda i: (i < 0) | (i >= n)  # noqa: B023, E731
            wrong.append((x > y) | (x < low) | (y > high) | ((edge(x) | edge(y)) & guarded))
            put = lambda p, i: np.where(edge(i), 0, p[np.where(edge(i), len(p) - 1, t.first[of] + i)])  # noqa: B023, E731
            starts.append(put(s, x))
            ends.append(put(e, y))
        gone = _joined(wrong, bool) | ~a_set | ~b_set
        return pa.StructArray.from_arrays([_list(_joined(x), counts, pa.int64(), gone) for x in (starts, ends)], names=["start", "end"])

    return _mapped("struct<start: array<bigint>, end: array<bigint>>", work, text, ts, te)


def _painted(n: int, ts: np.ndarray, te: np.ndarray) -> np.ndarray:
    """Tags of n tokens: of the spans (ts, te), in order, the last on a token decides. Painted from the last back, each token once."""
    tags, free = np.zeros(n, np.int16), list(range(n + 1))

    def next_free(i: int) -> int:
        root = i
        while free[root] != root:
            root = free[root]
        while free[i] != root:
            free[i], i = root, free[i]
        return root

    for a, b in zip(ts[::-1].tolist(), te[::-1].tolist(), strict=True):
        i = next_free(a)
        while i <= b:
            tags[i] = B if i == a else I
            free[i] = i + 1
            i = next_free(i)
    return tags


def bio(text: Column, start: Column, end: Column, specials: bool = False) -> Column:
    """An array of a tag for each token: O, B where a span begins, I inside of it; of overlapping spans the last by (start, end) decides; special tokens are IGNORED."""

    def work(table: np.ndarray, texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        (s, s_set, counts), (e, e_set, _) = _flat(starts), _flat(ends)
        upto = np.concatenate([[0], np.cumsum(counts)])
        tags, sizes = [], []
        for a, b, t in _groups(texts, table):
            here = slice(upto[a], upto[b])
            of, lo, hi = np.repeat(np.arange(b - a), counts[a:b]), s[here], e[here]
            ts, te = t.overlapping(of, lo, hi)
            good = np.flatnonzero((ts <= te) & s_set[here] & e_set[here])
            good = good[np.lexsort((hi[good], lo[good], of[good]))]
            # all texts at once: their tokens follow each other
            flat = _painted(len(t.s), ts[good] + t.first[of[good]], te[good] + t.first[of[good]])
            n = t.count
            if specials:
                flat, n = np.insert(flat, np.concatenate([t.first[:-1], t.first[1:]]), IGNORED), n + 2
            tags.append(flat)
            sizes.append(n)
        return _list(_joined(tags, np.int16), _joined(sizes), pa.int16())

    return _mapped("array<smallint>", work, text, start, end)


def runs(tags: Column) -> Column:
    """struct(ts, te): arrays of the runs B I* in an array of tags; an I behind no run is left out, special tokens don't close one."""

    def work(_: np.ndarray, column: pa.Array) -> pa.Array:
        flat, there, counts = _flat(column)
        of = np.repeat(np.arange(len(counts)), counts)
        at = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
        seen = there & (flat != IGNORED)
        flat, of, at = flat[seen], of[seen], at[seen]
        begins = (flat != I) | (np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool))
        start = np.flatnonzero(begins)
        last = np.append(start[1:], len(flat)) - 1
        real = flat[start] == B
        start, last = start[real], last[real]
        n = np.bincount(of[start], minlength=len(counts))
        return pa.StructArray.from_arrays([_list(at[start], n, pa.int64()), _list(at[last], n, pa.int64())], names=["ts", "te"])

    return _mapped("struct<ts: array<bigint>, te: array<bigint>>", work, tags)


def placed(spans: DataFrame, docs: DataFrame, key: str, text: str, containing: bool = False) -> DataFrame:
    """spans (key, start, end, ...) with ts, te on their documents' tokens, null without one; a document's spans meet its text once. Spans of documents that aren't there are left out."""
    lists = spans.groupBy(key).agg(F.collect_list(F.struct(*(c for c in spans.columns if c != key))).alias("spans"))
    return spread(docs.select(key, F.col(text).alias("_text")).join(lists, key), [key], "_text", containing)


def spread(rows: DataFrame, keep: list[str], text: str, containing: bool = False) -> DataFrame:
    """keep, the fields of rows' ``spans`` (an array of structs with start and end) and ts, te of each."""
    on = rows.select(*keep, "spans", aligned(F.col(text), F.col("spans.start"), F.col("spans.end"), containing).alias("_t"))
    each = on.select(*keep, F.explode(F.arrays_zip("spans", F.col("_t.ts").alias("ts"), F.col("_t.te").alias("te"))).alias("_z"))
    return each.select(*keep, "_z.spans.*", "_z.ts", "_z.te")


def _invalid(offsets_: Column) -> Column:
    return lambda k: (F.get(offsets_["s"], k.cast("int")) == 0) & (F.get(offsets_["e"], k.cast("int")) == 0)


def candidates(offsets_: Column, most: int, by_rank: bool = False) -> Column:
    """array of struct(ts, te): the token spans of at most ``most`` tokens of a struct(s, e) of offsets in which special tokens, (0, 0), may stand anywhere. A span ends before a special token; by_rank: special tokens are passed over instead and don't count."""
    n = F.size(offsets_["s"])
    special = _invalid(offsets_)
    index = lambda k: k.cast("bigint")
    every = F.when(n > 0, F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)).otherwise(F.array().cast("array<bigint>"))
    valid = F.filter(every, lambda k: ~special(k))
    if by_rank:
        ends = lambda at: F.slice(valid, at + 1, most)
        return F.flatten(F.transform(valid, lambda ts, at: F.transform(ends(at), lambda te: F.struct(index(ts).alias("ts"), index(te).alias("te")))))

    def from_(ts: Column) -> Column:
        run = F.filter(F.sequence(ts, F.least(ts + (most - 1), n.cast("bigint") - 1)), lambda te: ~F.exists(F.sequence(ts, te), special))
        return F.transform(run, lambda te: F.struct(index(ts).alias("ts"), index(te).alias("te")))

    return F.flatten(F.transform(valid, from_))
