"""Static range asymmetric numeral system over token ids.

A segment has one frequency table that its blocks share. A block is BLOCK ids, coded by LANES interleaved
states that share one stream of 32-bit words; it can be decoded alone. All blocks of a segment are coded in
step, a numpy operation for all lanes of all blocks.

Layout, little-endian: magic ``SRA1``; n_ids, n_symbols, n_blocks, table_bytes as u32; the table, zlib over the
ids as differences (u32) and the frequencies (u32); for each block the checkpoint (n_words u32, crc32 of the
block's ids u32, LANES states u64); crc32 of all before it u32; then the words of all blocks.
"""

from __future__ import annotations

import zlib

import numpy as np

MAGIC = b"SRA1"
#: log2 of the sum of a table's frequencies.
BITS = 18
LANES = 32
#: Ids in a block: those of all its lanes.
STEPS = 512
BLOCK = LANES * STEPS
_LOW = np.uint64(1 << 31)
_U = np.uint64
_CHECKPOINT = np.dtype([("words", "<u4"), ("crc", "<u4"), ("states", "<u8", (LANES,))])


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Positive frequencies that sum to 2^BITS, near the shares of ``counts`` (all positive)."""
    size = 1 << BITS
    if len(counts) > size // 2:
        raise ValueError(f"{len(counts)} different ids are too many for a table of {size} slots")
    share = np.maximum(1, np.floor(counts * ((size - len(counts)) / counts.sum())).astype(np.int64))
    rest = size - int(share.sum())
    order = np.argsort(-counts, kind="stable")
    if rest > 0:
        share[order] += rest // len(order)
        share[order[: rest % len(order)]] += 1
    while rest < 0:
        cut = order[share[order] > 1][:-rest]
        share[cut] -= 1
        rest += len(cut)
    return share


def encode(ids: np.ndarray) -> bytes:
    """A segment of at least one id."""
    if ids.max() < 1 << 22:
        totals = np.bincount(ids)
        symbols = np.flatnonzero(totals)
        counts = totals[symbols]
        of = (np.cumsum(totals > 0) - 1)[ids]
    else:
        symbols, of, counts = np.unique(ids, return_inverse=True, return_counts=True)
    freq = frequencies(counts)
    start = np.cumsum(freq) - freq
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.int64)
    grid[: len(of)] = of
    grid = grid.reshape(blocks, STEPS, LANES).transpose(1, 0, 2)
    state = np.full((blocks, LANES), _LOW)
    words = np.zeros((STEPS, blocks, LANES), np.uint32)
    put = np.zeros((STEPS, blocks, LANES), bool)
    f_of, s_of = freq.astype(np.uint64), start.astype(np.uint64)
    limit = f_of << _U(63 - BITS)
    for t in range(STEPS - 1, -1, -1):
        row = grid[t]
        f = f_of[row]
        put[t] = full = state >= limit[row]
        words[t] = state.astype(np.uint32)
        state = np.where(full, state >> _U(32), state)
        share = state // f
        state = (share << _U(BITS)) + (state - share * f) + s_of[row]
    marks = np.zeros(blocks, _CHECKPOINT)
    marks["words"] = put.sum(axis=(0, 2))
    marks["states"] = state
    whole = np.ascontiguousarray(ids, "<u4")
    marks["crc"] = [zlib.crc32(whole[i * BLOCK : (i + 1) * BLOCK]) for i in range(blocks)]
    table = zlib.compress(np.diff(symbols.astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes() + freq.astype("<u4").tobytes(), 6)
    head = MAGIC + np.array([len(ids), len(symbols), blocks, len(table)], "<u4").tobytes() + table + marks.tobytes()
    stream = words.transpose(1, 0, 2)[put.transpose(1, 0, 2)].astype("<u4")
    return head + zlib.crc32(head).to_bytes(4, "little") + stream.tobytes()


def decode(segment: bytes, blocks: tuple[int, int] | None = None) -> np.ndarray:
    """The ids of a segment, or those of its blocks [first, past); a damaged one raises ValueError."""
    n_ids, n_symbols, n_blocks, size = (int(x) for x in np.frombuffer(segment, "<u4", 4, 4)) if len(segment) >= 20 else (0, 0, 0, 0)
    at = 20 + size + n_blocks * _CHECKPOINT.itemsize
    if segment[:4] != MAGIC or len(segment) < at + 4 or zlib.crc32(segment[:at]) != int.from_bytes(segment[at : at + 4], "little"):
        raise ValueError("a damaged segment: its header is wrong")
    table = np.frombuffer(zlib.decompress(segment[20 : 20 + size]), "<u4")
    symbols = np.cumsum(table[:n_symbols], dtype=np.uint32)
    freq = table[n_symbols:].astype(np.uint64)
    start = np.cumsum(freq) - freq
    slots = np.repeat(np.arange(n_symbols), freq.astype(np.int64))
    marks = np.frombuffer(segment, _CHECKPOINT, n_blocks, 20 + size)
    stream = np.frombuffer(segment, "<u4", offset=at + 4)
    if len(stream) != marks["words"].sum():
        raise ValueError("a damaged segment: words are missing")
    a, b = blocks or (0, n_blocks)
    begins = np.cumsum(marks["words"], dtype=np.int64) - marks["words"]
    next_word, state = begins[a:b].copy(), marks["states"][a:b].copy()
    out = np.zeros((STEPS, b - a, LANES), np.int64)
    padded = np.append(stream, np.zeros(1, "<u4"))
    mask = _U((1 << BITS) - 1)
    for t in range(STEPS):
        slot = state & mask
        out[t] = s = slots[slot]
        state = freq[s] * (state >> _U(BITS)) + slot - start[s]
        empty = state < _LOW
        ranks = np.cumsum(empty, axis=1)
        word = padded[np.where(empty, np.minimum(next_word[:, None] + ranks - 1, len(stream)), len(stream))]
        state = np.where(empty, (state << _U(32)) | word, state)
        next_word += ranks[:, -1]
    if (state != _LOW).any():
        raise ValueError("a damaged segment: its words don't lead back to the first state")
    ids = symbols[out.transpose(1, 0, 2).reshape(-1)][: min(n_ids, b * BLOCK) - a * BLOCK].astype("<u4")
    for i in range(a, b):
        if zlib.crc32(ids[(i - a) * BLOCK : (i - a + 1) * BLOCK]) != marks["crc"][i]:
            raise ValueError(f"a damaged segment: block {i} has a wrong checksum")
    return ids
