"""Words of Arrow string columns and 64-bit hashes of them, whole batches at a time in numpy.

A word is a run of bytes other than space and 0x09-0x0D, in UTF-8. Hashes are polynomials modulo 2^64 over
random byte values, taken from prefix sums and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on together up to so many bytes; a longer one is worked on alone.
GROUP_BYTES = 1 << 20

_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves every output bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_P, _Q = 0x9FB21C651E98DF25, 0xD6E8FEB86659FD95
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i for i up to n at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(n + 1, GROUP_BYTES + 1)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _powers[base] = have = (made[0], made[1])
    return have


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * _power(base, len(values))[0][: len(values)], out=out[1:])
    return out


class Words:
    """The words of some consecutive texts. ``first`` has, for each text and one past the last, the index of its first word."""

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, lower: bool):
        """bounds: where each text starts in buf, and where the last ends."""
        bounds = bounds - bounds[0]
        if lower:
            buf = _LOWER[buf]
        self.buf = buf
        ink = ~_WS[buf]
        edge = np.zeros(len(buf) + 1, bool)
        edge[bounds] = True
        before = np.ones(len(buf), bool)
        before[1:] = ~ink[:-1]
        before |= edge[:-1]
        after = np.ones(len(buf), bool)
        after[:-1] = before[1:] | ~ink[1:]
        self.starts = np.flatnonzero(ink & before)
        self.ends = np.flatnonzero(ink & after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def hashes(self) -> np.ndarray:
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sums = _prefix(_BYTE[self.buf], _P)
        return mix((sums[self.ends] - sums[self.starts]) * _power(_P, len(self.buf))[1][self.starts] + (self.ends - self.starts).astype(np.uint64))

    def last(self) -> np.ndarray:
        """For each word, the index one past its text's last word."""
        return np.repeat(self.first[1:], np.diff(self.first))


def sequences(hashes: np.ndarray) -> np.ndarray:
    """Prefix sums, for spans()."""
    return _prefix(hashes, _Q)


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the word sequences [start, end)."""
    return mix((sums[end] - sums[start]) * _power(_Q, len(sums))[1][start] + (end - start).astype(np.uint64))


def groups(column: pa.Array, lower: bool = False, most: int = GROUP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, row past the last, their words) of texts of ``most`` bytes together; null is an empty text."""
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1], lower)
        a = b


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of the given lengths over flat values."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values).cast(kind))
