"""Negatives for training, drawn without making all candidates: a keyed permutation of the candidates' ranks.

Candidates of at most L of a document's n tokens are ranked by length, then by their first token: length d + 1 begins
at rank d * n - d * (d - 1) / 2. A permutation of the ranks, a Feistel network over the least power of four that holds
them, keyed by the document, fixes in what order they are drawn; what falls beyond the ranks is passed over. The first
draws are the sample. Candidates that touch gold are few and near it, and their places in that order come from the
inverse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .digests import uniform

#: Multipliers of the rounds, and the prime that a round is taken modulo.
ROUNDS, PRIME = (48271, 69621, 40692, 16807), 2147483647


def starts(n: int, most: int) -> np.ndarray:
    """The rank at which each length begins, and the number of candidates."""
    d = np.arange(min(n, most) + 1, dtype=np.int64)
    return d * n - d * (d - 1) // 2


def half_bits(total: int) -> int:
    """Bits of half a rank in the permutation of ``total`` ranks."""
    bits = 1
    while 4**bits < total:
        bits += 1
    return bits


def key_of(text: str) -> int:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:7], 16)


def _round(x: np.ndarray, a: int, key: int, mask: int) -> np.ndarray:
    return (x * a + key) % PRIME & mask


def drawn(j: np.ndarray, key: int, bits: int) -> np.ndarray:
    """What is drawn at places j; it may be beyond the ranks."""
    mask = (1 << bits) - 1
    left, right = j >> bits, j & mask
    for a in ROUNDS:
        left, right = right, left ^ _round(right, a, key, mask)
    return left << bits | right


def place(rank: np.ndarray, key: int, bits: int) -> np.ndarray:
    """The inverse of drawn()."""
    mask = (1 << bits) - 1
    left, right = rank >> bits, rank & mask
    for a in reversed(ROUNDS):
        left, right = right ^ _round(left, a, key, mask), left
    return left << bits | right


def spans_of(rank: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The candidates of ranks."""
    d = np.searchsorted(begins, rank, side="right") - 1
    ts = rank - begins[d]
    return ts, ts + d


def draws(n: int, most: int, key: str, wanted: int, fits) -> tuple[np.ndarray, np.ndarray]:
    """The first ``wanted`` candidates in the key's order for which fits(ts, te) holds, or all that there are."""
    begins = starts(n, most)
    total = int(begins[-1])
    bits, number = half_bits(total), key_of(key)
    found, have, at = [], 0, 0
    size = max(64, 4 * wanted)
    while have < wanted and at < 4**bits:
        rank = drawn(np.arange(at, min(at + size, 4**bits), dtype=np.int64), number, bits)
        ts, te = spans_of(rank[rank < total], begins)
        good = np.flatnonzero(fits(ts, te))[: wanted - have]
        found.append((ts[good], te[good]))
        have, at, size = have + len(good), at + size, min(2 * size, 1 << 16)
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate([f[i] for f in found]) if found else empty for i in (0, 1))


class _Gold:
    """A document's gold places among its candidates."""

    def __init__(self, n: int, most: int, places: list[tuple[int, int]]):
        self.n, self.most = n, most
        covered = np.zeros(n + 1, np.int64)
        for ts, te in places:
            covered[ts] += 1
            covered[min(te, n - 1) + 1] -= 1
        self.before = np.concatenate([[0], np.cumsum(np.cumsum(covered[:n]) > 0)])
        held = sorted({(ts, te) for ts, te in places if te - ts < most and te < n})
        self.ts, self.te = (np.array([p[i] for p in held], np.int64) for i in (0, 1))
        begins = starts(n, most)
        self.ranks = np.sort(begins[self.te - self.ts] + self.ts) if held else np.zeros(0, np.int64)
        self.begins = begins

    def touched(self, ts: np.ndarray, te: np.ndarray) -> np.ndarray:
        """Which candidates share a token with gold."""
        return self.before[te + 1] > self.before[ts]

    def held(self, ts: np.ndarray, te: np.ndarray) -> np.ndarray:
        """Which candidates are gold."""
        return np.isin(self.begins[te - ts] + ts, self.ranks)

    def around(self) -> tuple[np.ndarray, np.ndarray]:
        """The candidates that touch gold and aren't gold."""
        near = np.diff(self.before) > 0
        window = np.convolve(near, np.ones(self.most))[self.most - 1 : self.most - 1 + self.n] > 0 if self.n else near
        first = np.flatnonzero(window)
        ts, d = (x.ravel() for x in np.meshgrid(first, np.arange(self.most), indexing="ij"))
        te = ts + d
        good = te < self.n
        ts, te = ts[good], te[good]
        good = self.touched(ts, te) & ~self.held(ts, te)
        return ts[good], te[good]


#: Candidates: ts, te, positive, hard.
Drawn = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _together(*parts: tuple[np.ndarray, np.ndarray, bool, bool | np.ndarray]) -> Drawn:
    return (*(np.concatenate([p[i] for p in parts]) for i in (0, 1)), *(np.concatenate([np.broadcast_to(np.asarray(p[i], bool), len(p[0])) for p in parts]) for i in (2, 3)))


def _rows(drawn_: Drawn) -> list[tuple[int, int, bool, bool]]:
    return list(zip(*(x.tolist() for x in drawn_), strict=True))


def _budget(n: int, places: list[tuple[int, int]], key: str, most: int, hard_each: int, easy_each: int, without: int) -> Drawn:
    gold = _Gold(n, most, places)
    of = len(gold.ts)
    hard_ts, hard_te = gold.around()
    order = np.argsort(place(gold.begins[hard_te - hard_ts] + hard_ts, key_of(key), half_bits(int(gold.begins[-1]))), kind="stable")[: hard_each * of if of else without]
    ts, te = draws(n, most, key, easy_each * of if of else without, lambda a, b: ~gold.touched(a, b))
    return _together((gold.ts, gold.te, True, True), (hard_ts[order], hard_te[order], False, True), (ts, te, False, False))


def budget(n: int, places: list[tuple[int, int]], key: str, most: int, hard_each: int, easy_each: int, without: int) -> list[tuple[int, int, bool, bool]]:
    """(ts, te, positive, hard) of a document's gold, and of as many hard and easy negatives for each, or ``without`` easy or hard ones where there is no gold."""
    return _rows(_budget(n, places, key, most, hard_each, easy_each, without)) if n > 0 else []


def _share(n: int, places: list[tuple[int, int]], key: str, most: int, rate: float) -> Drawn:
    gold = _Gold(n, most, places)
    ts, te = draws(n, most, key, int(rate * (int(gold.begins[-1]) - len(gold.ts)) + 1e-9), lambda a, b: ~gold.held(a, b))
    return _together((gold.ts, gold.te, True, True), (ts, te, False, gold.touched(ts, te)))


def share(n: int, places: list[tuple[int, int]], key: str, most: int, rate: float) -> list[tuple[int, int, bool, bool]]:
    """(ts, te, positive, hard) of a document's gold and of the share ``rate``, rounded down, of its other candidates."""
    return _rows(_share(n, places, key, most, rate)) if n > 0 else []


#: First tokens whose candidates are worked on together.
_FIRSTS = 1 << 12


def _places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ts and te of the structs in a column of lists, ts past te where one is null, and where each row's begin; a null list is an empty one."""
    ts, te = column.flatten().flatten()[:2]
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return ts.fill_null(1 << 62).to_numpy(zero_copy_only=False), te.fill_null(-1).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


class _Near:
    """Places in a batch of rows, on the tokens of all its rows one after another: which of them touch candidates."""

    def __init__(self, column: pa.Array, n: np.ndarray, base: np.ndarray, kind: pa.DataType):
        ts, te, upto = _places(column)
        row = np.repeat(np.arange(len(n)), np.diff(upto))
        # a row without tokens has a place for (0, 0)
        room = np.maximum(n, 1)[row]
        self.index = np.flatnonzero((ts < room) & (te >= 0) & (ts <= te))
        row, room = row[self.index], room[self.index]
        self.ts, self.te = base[row] + np.maximum(ts[self.index], 0), base[row] + np.minimum(te[self.index], room - 1)
        self.values, self.kind = column.flatten(), kind

    def touching(self, ts: np.ndarray, te: np.ndarray, most: int) -> pa.ListArray:
        """Of candidates in the order of ts, each of ``most`` tokens or less, the places that share a token with it, in their rows' order; null for none."""
        some = np.flatnonzero((self.te >= ts[0]) & (self.ts < ts[-1] + most)) if len(ts) else np.zeros(0, np.int64)
        low, high = np.searchsorted(ts, self.ts[some] - (most - 1), side="left"), np.searchsorted(ts, self.te[some], side="right")
        many = np.maximum(high - low, 0)
        place = np.repeat(some, many)
        cand = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
        good = self.ts[place] <= te[cand]
        place, cand = place[good], cand[good]
        counts = np.bincount(cand, minlength=len(ts))
        bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(counts == 0, False)), self.values.take(pa.array(self.index[place[np.argsort(cand, kind="stable")]])).cast(self.kind.value_type))


def _sampled(most: int, rate: float | None, fallback: bool, near: list[str], held: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("ts", pa.int64()), ("te", pa.int64()), ("label", pa.string())]))
    for batch in batches:
        keys, heads = batch.column("_key"), [b"%b:" % (h or "").encode("utf-8", "surrogatepass") for h in batch.column("_head").to_pylist()]
        given = batch.column("_n")
        n = np.maximum(given.fill_null(0).to_numpy(zero_copy_only=False), 0)
        # a place for a candidate of rows without tokens
        base = np.concatenate([[0], np.cumsum(np.maximum(n, 1))])
        code = lambda row, ts, te: (base[row] + ts) * most + te - ts  # noqa: B023, E731
        codes = []
        for ts, te, upto in (_places(batch.column(c)) for c in held):
            row = np.repeat(np.arange(len(n)), np.diff(upto))
            good = np.flatnonzero((ts >= 0) & (ts <= te) & (te - ts < most) & (te < n[row]))
            codes.append(code(row[good], ts[good], te[good]))
        kept = np.unique(np.concatenate([np.zeros(0, np.int64), *codes]))
        places = [_Near(batch.column(c), n, base, kind) for c in near]
        with_any = np.zeros(len(n), bool)

        def made(row: np.ndarray, ts: np.ndarray, te: np.ndarray) -> pa.RecordBatch:
            lists = [p.touching(base[row] + ts, base[row] + te, most) for p in places]  # noqa: B023
            return pa.RecordBatch.from_arrays([keys.take(pa.array(row)), pa.array(ts), pa.array(te), *lists], names=["_key", "ts", "te", *near])  # noqa: B023

        # the rows' first tokens, one after another; a row's may be cut
        first = np.concatenate([[0], np.cumsum(n)])
        for lo in range(0, int(first[-1]), _FIRSTS):
            at = np.arange(lo, min(lo + _FIRSTS, int(first[-1])))
            row = np.searchsorted(first, at, side="right") - 1
            ts = at - first[row]
            te = ts[:, None] + np.arange(most)
            take = te < n[row][:, None]
            if rate is not None:
                chosen = uniform([b"%b%d:" % (heads[r], t) for r, t in zip(row.tolist(), ts.tolist(), strict=True)], ts, most) <= rate
                a, b = np.searchsorted(kept, [code(row[0], ts[0], ts[0]), code(row[-1], ts[-1], ts[-1] + most)])
                chosen[np.searchsorted(base[row] + ts, kept[a:b] // most), kept[a:b] % most] = True
                take &= chosen
            i, d = np.nonzero(take)
            if len(i):
                with_any[row[i]] = True
                yield made(row[i], ts[i], te[i, d])
        if fallback:
            none = np.flatnonzero(~with_any & given.is_valid().to_numpy(zero_copy_only=False))
            zero = np.zeros(len(none), np.int64)
            if len(none):
                yield made(none, zero, zero)


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """Small rows out of which many are made, over as many tasks as shuffles have: by their own size Spark would put them in one."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def sampled(docs: DataFrame, key: str, most: int, rate: float | None, near: list[str], held: list[str], fallback: bool = False) -> DataFrame:
    """key, ts, te of candidates of at most ``most`` tokens of docs (key, n, and columns of lists of places), and of each in the columns ``near`` the places there that share a token with it, null for none.

    With ``rate``, candidates that stand at a place of the columns ``held`` and the share of the others that their
    digests choose; else all. fallback: a document that is left without any has (0, 0). Candidates leave a task a few
    thousand first tokens at a time, whatever a document's length; places are not copied to candidates they don't touch.
    """
    placed = "array<struct<ts:bigint,te:bigint,label:string>>"
    pair = lambda c: F.transform(c, lambda g: F.struct(g["ts"].cast("bigint").alias("ts"), g["te"].cast("bigint").alias("te")))
    rows = docs.select(F.col(key).alias("_key"), F.concat_ws(":", F.lit("neg"), key).alias("_head"), F.col("n").cast("bigint").alias("_n"), *(F.col(c).cast(placed).alias(c) for c in near), *(pair(F.col(c)).alias(f"_held_{c}") for c in held))
    names = [f"_held_{c}" for c in held]
    out = dealt(rows, "_key", "_n").mapInArrow(lambda batches: _sampled(most, rate, fallback, near, names, batches), ", ".join([f"_key {rows.schema['_key'].dataType.simpleString()}", "ts bigint, te bigint", *(f"{c} {placed}" for c in near)]))
    return out.withColumnRenamed("_key", key)


#: Drawn candidates that leave a task together.
_TOGETHER = 1 << 16


def _made(work, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The candidates of each row's document, some at a time: rows wait for as many as _TOGETHER, and those of a longer document leave in parts."""
    for batch in batches:
        keys, names, sizes = batch.column("_key"), batch.column("_head").to_pylist(), batch.column("_n").to_pylist()
        ts, te, upto = _places(batch.column("types"))
        held: list[tuple[int, Drawn]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:  # noqa: B023
                row = np.repeat([r for r, _ in held], [len(d[0]) for _, d in held])  # noqa: B023
                columns = [np.concatenate([d[i] for _, d in held]) for i in range(4)]  # noqa: B023
                held.clear()  # noqa: B023
                for a in range(0, len(row), _TOGETHER):
                    part = slice(a, a + _TOGETHER)
                    yield pa.RecordBatch.from_arrays([keys.take(pa.array(row[part])), *(pa.array(c[part]) for c in columns)], names=["_key", "ts", "te", "positive", "hard"])  # noqa: B023

        waiting = 0
        for k, (name, n) in enumerate(zip(names, sizes, strict=True)):
            if n and n > 0:
                here = slice(upto[k], upto[k + 1])
                good = ts[here] <= te[here]
                held.append((k, work(n, list(zip(ts[here][good].tolist(), te[here][good].tolist(), strict=True)), name or "")))
                waiting += len(held[-1][1][0])
            if waiting >= _TOGETHER:
                yield from flush()
                waiting = 0
        yield from flush()


def _rows_of(docs: DataFrame, key: str, name: str, work) -> DataFrame:
    """key, ts, te, positive, hard: what ``work`` draws for the rows of docs (key, n, types), by ``name`` and key."""
    places_ = F.transform("types", lambda g: F.struct(g["ts"].cast("bigint").alias("ts"), g["te"].cast("bigint").alias("te")))
    rows = docs.select(F.col(key).alias("_key"), F.concat_ws(":", F.lit(name), key).alias("_head"), F.col("n").cast("bigint").alias("_n"), places_.alias("types"))
    out = dealt(rows, "_key", "_n").mapInArrow(lambda batches: _made(work, batches), f"_key {rows.schema['_key'].dataType.simpleString()}, ts bigint, te bigint, positive boolean, hard boolean")
    return out.withColumnRenamed("_key", key)


def budgeted(docs: DataFrame, key: str, most: int, hard_each: int, easy_each: int, without: int) -> DataFrame:
    """budget() of the documents ``docs`` (key, n tokens, types: gold, an array of struct(ts, te, ...)) as rows."""
    return _rows_of(docs, key, "budget", lambda n, places, k: _budget(n, places, k, most, hard_each, easy_each, without))


def shared(docs: DataFrame, key: str, most: int, rate: float) -> DataFrame:
    """share() of the documents ``docs`` (key, n tokens, types: gold, an array of struct(ts, te, ...)) as rows."""
    return _rows_of(docs, key, "share", lambda n, places, k: _share(n, places, k, most, rate))
