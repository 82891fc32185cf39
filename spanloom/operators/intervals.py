"""Which spans of a document stay when each, in order of preference, must not clash with those before: by sorted intervals.

Spans are half open. What stays without overlapping is disjoint, and what stays by a ratio below one is never inside of
another, so in both cases starts and ends are sorted alike, and two binary searches find what a span could clash with.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Disjoint:
    """Takes spans that overlap none taken before."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        if start >= end:
            return True  # overlaps nothing
        at = bisect_left(self.starts, end)
        if at and self.ends[at - 1] > start:
            return False
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


class Apart:
    """Takes spans whose overlap with each taken before is at most ``bound`` of the shorter of the two."""

    def __init__(self, bound: float) -> None:
        self.bound, self.any = bound, False
        self.starts: list[int] = []
        self.ends: list[int] = []

    def take(self, start: int, end: int) -> bool:
        if self.bound < 0:
            # even no overlap is more than that
            first, self.any = not self.any, True
            return first
        if self.bound >= 1 or start >= end:
            return True
        lo, hi = bisect_right(self.ends, start), bisect_left(self.starts, end)
        # those across its start, few as they hardly overlap each other, and then the first inside of it decides
        for k in range(lo, hi):
            s, e = self.starts[k], self.ends[k]
            if (min(e, end) - max(s, start)) / min(e - s, end - start) > self.bound:
                return False
        at = bisect_left(self.starts, start)
        self.starts.insert(at, start)
        self.ends.insert(at, end)
        return True


def meeting(left: list[tuple[int, int]], right: list[tuple[int, int]], empties: bool = False) -> list[tuple[int, int]]:
    """(i, j) of the spans of both sides that overlap, once each: a sweep by their starts, which looks at what is still open alone. empties: spans of no length meet equal ones."""
    events = sorted([(s, 0, k) for k, (s, e) in enumerate(left) if s < e] + [(s, 1, k) for k, (s, e) in enumerate(right) if s < e])
    sides = left, right
    open_: tuple[list[int], list[int]] = ([], [])
    found = []
    for start, side, k in events:
        other = 1 - side
        still = [x for x in open_[other] if sides[other][x][1] > start]
        open_[other][:] = still
        found += [(k, x) if side == 0 else (x, k) for x in still]
        open_[side].append(k)
    if empties:
        places: dict[tuple[int, int], list[int]] = {}
        for j, span in enumerate(right):
            if span[0] >= span[1]:
                places.setdefault(span, []).append(j)
        found += [(i, j) for i, span in enumerate(left) for j in places.get(span, ())]
    return found


def met(left: Column, right: Column, empties: bool = False, outer: bool = False) -> Column:
    """An array of struct(i, j): the indices of spans (structs with start and end) of both arrays that overlap; see meeting(). outer: left ones that meet none too, with j null."""
    kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32())]))

    def batches(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in it:
            rows = []
            for a, b, c, d in zip(*map(_arrays, columns), strict=True):
                pairs = meeting(list(zip(a, b, strict=True)), list(zip(c, d, strict=True)), empties)
                alone = set(range(len(a))) - {i for i, _ in pairs} if outer else ()
                rows.append([{"i": i, "j": j} for i, j in pairs] + [{"i": i, "j": None} for i in sorted(alone)])
            yield pa.array(rows, kind)

    batches.__annotations__ = {"it": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<struct<i:int,j:int>>")(left["start"], left["end"], right["start"], right["end"])


def joined(left: DataFrame, right: DataFrame, keys: list[str], empties: bool = False, outer: bool = False) -> DataFrame:
    """keys, l and r: the spans (start, end and other columns, as structs) of both sides that overlap within equal keys. outer: left ones that meet none too, with r null. Rows of a key meet in one row, as those of a document do."""
    lists = lambda df, name: df.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in df.columns if c not in keys))).alias(name))
    both = lists(left, "ls").join(lists(right, "rs"), keys, "left" if outer else "inner")
    pairs = F.transform(met(F.col("ls"), F.col("rs"), empties, outer), lambda p: F.struct(F.get("ls", p["i"]).alias("l"), F.when(p["j"].isNotNull(), F.get("rs", F.coalesce(p["j"], F.lit(0)))).alias("r")))
    return both.select(*keys, F.explode(pairs).alias("p")).select(*keys, "p.l", "p.r")


def _arrays(column: pa.Array) -> list[list]:
    return [x or [] for x in column.to_pylist()]


def _chosen(work, *columns: Column) -> Column:
    """``work`` of a row's arrays, as an array of indices."""

    def batches(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for several in it:
            yield pa.array([work(*row) for row in zip(*map(_arrays, several), strict=True)], pa.list_(pa.int32()))

    batches.__annotations__ = {"it": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(batches, "array<int>")(*columns)


def disjoint(spans: Column, iou: float | None = None) -> Column:
    """Of an array of structs with start and end, the indices of those that overlap none before that stays. iou: nor reach it; where that is 0 or less the first alone stays."""

    def work(starts: Iterable[int], ends: Iterable[int]) -> list[int]:
        if iou is not None and iou <= 0:
            return [0] if starts else []
        kept = Disjoint()
        return [k for k, (s, e) in enumerate(zip(starts, ends, strict=True)) if kept.take(s, e)]

    return _chosen(work, spans["start"], spans["end"])


def by_label(spans: Column, same: float, cross: float | None) -> Column:
    """Of an array of structs with rank, ord, start, end and label, in the order of rank and ord, the indices of those that stay within their label and then across labels, in the order of rank, of the labels' least ord, and of ord."""

    def work(ranks: list, ords: list, starts: list, ends: list, labels: list) -> list[int]:
        first: dict[str, int] = {}
        sides: dict[str, Apart] = {}
        kept = []
        for k, (o, s, e, label) in enumerate(zip(ords, starts, ends, labels, strict=True)):
            first[label] = min(first.get(label, o), o)
            if sides.setdefault(label, Apart(same)).take(s, e):
                kept.append(k)
        kept.sort(key=lambda k: (ranks[k], first[labels[k]], ords[k]))
        if cross is None:
            return kept
        whole = Apart(cross)
        return [k for k in kept if whole.take(starts[k], ends[k])]

    return _chosen(work, *(spans[c] for c in ("rank", "ord", "start", "end", "label")))


def one_to_one(left: Column, right: Column) -> Column:
    """Of two arrays, the indices at which neither side's number was there before at an index that stays."""

    def work(a: list[int], b: list[int]) -> list[int]:
        seen_a, seen_b, kept = set(), set(), []
        for k, (x, y) in enumerate(zip(a, b, strict=True)):
            if x not in seen_a and y not in seen_b:
                seen_a.add(x)
                seen_b.add(y)
                kept.append(k)
        return kept

    return _chosen(work, left, right)


def picked(spans: Column, indices: Column) -> Column:
    return F.transform(indices, lambda k: F.get(spans, k))
