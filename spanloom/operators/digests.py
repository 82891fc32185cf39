"""The numbers in [0, 1) that candidates' digests fix, many at a time: MD5 over whole numpy columns."""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np

_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for s in four]
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_WORDS = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5(words: np.ndarray, used: int) -> np.ndarray:
    """The first word of the digests of messages of one block, words[i] being the i-th of all of them; from ``used`` on they are 0, but for the size."""
    a, b, c, d = (np.full(words.shape[1], s, np.uint32) for s in _START)
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        a += f
        if _WORDS[i] < used or _WORDS[i] == 14:
            a += words[_WORDS[i]]
        a += _SINES[i]
        np.left_shift(a, np.uint32(_SHIFTS[i]), out=g)
        np.right_shift(a, np.uint32(32 - _SHIFTS[i]), out=a)
        a |= g
        a += b
        a, b, c, d = d, a, b, c
    return a + np.uint32(_START[0])


def _spelled(values: np.ndarray) -> np.ndarray:
    """The digits of numbers below 10^7 and what MD5 puts behind a message, as bytes of a little-endian number."""
    out, rest = np.full(values.shape, 0x80, np.uint64), values.astype(np.uint64)
    for k in range(7):
        tens = rest // 10
        out = np.where((rest > 0) | (k == 0), out << np.uint64(8) | (rest - tens * 10 + 48), out)
        rest = tens
    return out


@functools.cache
def _small() -> np.ndarray:
    return _spelled(np.arange(1 << 16))


def uniform(heads: list[bytes], ts: np.ndarray, most: int) -> np.ndarray:
    """functions.columns.uniform() of each head followed by the number ts + d, for d below ``most``: a row for each head."""
    sizes, te = np.fromiter(map(len, heads), np.int64, len(heads)), ts + np.arange(most)[:, None]
    if not len(heads):
        return np.zeros((0, most))
    if sizes.max() > 46 or te.max() >= 10**7:
        # more than a block may hold
        number = lambda h, v: int(hashlib.md5(b"%b%d" % (h, v), usedforsecurity=False).hexdigest()[:8], 16)
        return np.array([[number(h, v + d) for d in range(most)] for h, v in zip(heads, ts.tolist(), strict=True)]) / 4294967296.0
    order = np.argsort(sizes, kind="stable")
    sizes, te = sizes[order], te[:, order]
    words = np.empty((16, most, len(heads)), np.uint32)
    words[:] = np.frombuffer(b"".join([heads[i].ljust(64, b"\0") for i in order.tolist()]), "<u4").reshape(-1, 16).T[:, None]
    tails = _small()[te] if te.max() < 1 << 16 else _spelled(te)
    # heads of one size lie together, and what follows them begins at the same byte
    for size in np.unique(sizes).tolist():
        here = slice(*np.searchsorted(sizes, [size, size + 1]).tolist())
        at, shift, tail = size // 4, size % 4 * 8, tails[:, here]
        low = tail << np.uint64(shift)
        words[at, :, here] |= low.astype(np.uint32)
        words[at + 1, :, here] |= (low >> np.uint64(32)).astype(np.uint32)
        if shift:
            words[at + 2, :, here] |= (tail >> np.uint64(64 - shift)).astype(np.uint32)
    words[14] = 8 * (sizes + 1 + sum((te >= 10**k).astype(np.uint8) for k in range(1, 7)))
    out = np.empty((len(heads), most))
    out[order] = _md5(words.reshape(16, -1), int(sizes[-1]) // 4 + 3).byteswap().reshape(most, -1).T / 4294967296.0
    return out
