"""4. SimHash fingerprints of documents, and those near each other by permuted block tables.

Terms are pairs of neighbouring words, and runs of GRAM bytes of which every other one counts, by its hash.
Each term's hash votes with the term's weight on every bit. Two fingerprints that differ in at most r bits differ in
at most s bits in one of r // (s + 1) + 1 blocks. Each of as many tables is led by another block: there a fingerprint
that is asked for meets those whose block differs from its own in s bits at most. The more fingerprints there are, the
larger s and with it the blocks, so that a bucket's size and the copies of what is asked don't grow with their number.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, words

#: Bits of a fingerprint; it is handled as BITS / 64 numbers.
BITS = 256
#: Bits in which near fingerprints differ at most: covers pairs with a five-word Jaccard similarity of 0.8 (see the README).
RADIUS = 39
#: From this radius on, blocks may differ in one bit at least: equal ones alone would be too short.
WIDE = 16
#: Bits in which blocks may differ at most, and what sending a probe to its bucket costs, in comparisons.
MOST_SPREAD, PROBE_COST = 3, 200
GRAM, GRAM_WEIGHT, PAIR_WEIGHT = 8, 0.6, 1.0
#: Fingerprints of a bucket that a task compares with as many others at a time.
BLOCK = 512
#: Buckets whose sizes are broadcast, at most: some 10 MB. There are no more than tables times values of a block.
BROADCAST_BUCKETS = 1 << 18
#: Texts whose terms are counted together, so that these stay in a processor's cache.
_GROUP_BYTES = 1 << 17
_PARTS = BITS // 64
_U = np.uint64
_SEEDS = words.mix(np.arange(1, _PARTS + 1, dtype=np.uint64))


def _terms(w: words.Words, bounds: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each kind of term: hashes, how many each text has, weight."""
    hashes, last = w.hashes(), w.last()
    sums = words.sequences(hashes)
    first = np.arange(len(hashes))
    # a text's last word is a term of its own
    pairs = words.spans(sums, first, np.minimum(first + 2, last))
    size = len(w.buf)
    place = np.arange(max(0, size - GRAM + 1))
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(place)]
    good = place + GRAM <= bounds[of + 1]
    place, of = place[good], of[good]
    bytes_ = words._prefix(words._BYTE[w.buf], words._P)
    grams = words.mix((bytes_[place + GRAM] - bytes_[place]) * words._power(words._P, size)[1][place])
    taken = (grams & _U(1)) == 0
    return [(pairs, np.diff(w.first), PAIR_WEIGHT), (grams[taken], np.bincount(of[taken], minlength=len(bounds) - 1), GRAM_WEIGHT)]


def _sum3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit by bit the sum of three: its ones and its twos."""
    odd = a ^ b
    return odd ^ c, (a & b) | (odd & c)


def _sums(rows: list[np.ndarray]) -> list[np.ndarray]:
    """Bit by bit the sum of arrays, as planes of ones, twos, fours, ..."""
    planes = []
    while rows:
        carried = []
        while len(rows) > 2:
            low, high = _sum3(*rows[:3])
            rows = [*rows[3:], low]
            carried.append(high)
        if len(rows) == 2:
            carried.append(rows[0] & rows[1])
            rows = [rows[0] ^ rows[1]]
        planes.append(rows[0])
        rows = carried
    return planes


#: Hashes whose bits are added up as words of 64, before they are counted one by one: sums up to here have six planes.
_TOGETHER = 63


def _counts(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, how many of its terms' hashes of BITS bits have each bit."""
    blocks = -(-counts // _TOGETHER)
    out = np.zeros((len(counts), BITS), np.int64)
    if not len(hashes):
        return out
    first = np.cumsum(blocks) - blocks
    # each text's hashes fill whole blocks, with zeros behind
    at = np.arange(len(hashes)) + np.repeat(first * _TOGETHER - (np.cumsum(counts) - counts), counts)
    total = int(blocks.sum())
    block = at // _TOGETHER
    at = (at - block * _TOGETHER) * total + block
    bits = np.zeros((total, BITS), np.uint8)
    for part in range(_PARTS):
        rows = np.zeros(_TOGETHER * total, np.uint64)
        rows[at] = words.mix(hashes + _SEEDS[part])
        own = bits[:, part * 64 : part * 64 + 64]
        for k, plane in enumerate(_sums(list(rows.reshape(_TOGETHER, total)))):
            own += np.unpackbits(plane.view(np.uint8).reshape(total, 8), axis=1, bitorder="little") << np.uint8(k)
    for text, (start, n) in enumerate(zip(first.tolist(), blocks.tolist(), strict=True)):
        out[text] = bits[start : start + n].sum(axis=0, dtype=np.int32)
    return out


def fingerprints(column: pa.Array) -> np.ndarray:
    """A row of BITS / 64 unsigned numbers for each text; null is an empty text, whose fingerprint is 0."""
    out = np.zeros((len(column), _PARTS), np.uint64)
    column = column.cast(pa.large_string())
    lengths = np.array(pa.compute.fill_null(pa.compute.binary_length(column), 0), np.int64)
    for a, b, w in words.groups(column, most=_GROUP_BYTES):
        votes = np.zeros((b - a, BITS))
        for hashes, counts, weight in _terms(w, np.concatenate([[0], np.cumsum(lengths[a:b])])):
            votes += weight * (2 * _counts(hashes, counts) - counts[:, None])
        # a bit needs a clear majority, so that no rounding decides
        out[a:b] = np.packbits(votes > 1e-6, axis=1, bitorder="little").view(np.uint64)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The share of equal bits."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=-1) / BITS


def edited(text: str, following: str) -> str:
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _hex(rows: np.ndarray) -> list[str]:
    return ["".join(f"{int(x):016x}" for x in r) for r in rows]


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), *((f"f{i}", pa.int64()) for i in range(_PARTS))]
_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, " + ", ".join(f"f{i} long" for i in range(_PARTS))
#: Rows for the ends of a task's range come besides, with texts: of its first document (edge 0) and its last (edge 1).
_EDGED = _COLUMNS + ", task int, edge int, text string"


def _made(ids: pa.Array, texts: list[str], following: list[str]) -> list[pa.Array]:
    own, next_ = fingerprints(pa.array(texts, pa.large_string())), fingerprints(pa.array(following[-1:], pa.large_string()))
    # all but the last document's next is the row below
    nexts = np.concatenate([own[1:], next_])
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    others = fingerprints(pa.array(changed, pa.large_string()))
    return [ids, pa.array([len(t) for t in texts]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]), pa.array(_hex(own)), pa.array(_hex(others)), pa.array(likeness(own, others)), pa.array(likeness(own, nexts)), *(pa.array(own[:, i].view(np.int64)) for i in range(_PARTS))]


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _EDGED from documents in order: results of all but the last, and both edges."""
    task = TaskContext.get().partitionId()
    names = [n for n, _ in _FIELDS]

    def edge(doc_id: int | None, text: str, which: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for _, t in _FIELDS[1:]), pa.array([task], pa.int32()), pa.array([which], pa.int32()), pa.array([text])], names=[*names, "task", "edge", "text"])

    held: tuple[int | None, str] | None = None
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        if not ids:
            continue
        if held is None:
            yield edge(ids[0], texts[0], 0)
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        for a in range(0, len(ids) - 1, 2048):
            b = min(a + 2048, len(ids) - 1)
            columns = _made(pa.array(ids[a:b], pa.int64()), texts[a:b], texts[a + 1 : b + 1])
            yield pa.RecordBatch.from_arrays([*columns, pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.string())], names=[*names, "task", "edge", "text"])
    if held is not None:
        yield edge(*held, 1)


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield pa.RecordBatch.from_arrays(_made(batch.column("doc_id").slice(i, 1), [batch.column("text")[i].as_py()], [batch.column("following")[i].as_py()]), names=[n for n, _ in _FIELDS])


def with_next(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (doc_id, text; other columns are left out) the columns of the query, and f0, f1, ...: the fingerprint as numbers.

    A null text is an empty one; a text of any length is fingerprinted as a whole. Rows stand in the order of
    doc_id, nulls first, those of one doc_id in that of their texts; the last one's next is the first. No rows give
    none. The result reads from a table in the shared folder.
    """
    with common.scratch(docs.sparkSession) as scratch:
        result, table = _with_next(docs, scratch)
        scratch.keep(table)
        return result


def _with_next(docs: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    made = scratch.table(common.in_order(rows).mapInArrow(_in_order, _EDGED), "fingerprints")
    columns = [n for n, _ in _FIELDS]
    # the last document of a task goes with the first of the next: as many rows as tasks, in order without their texts
    first = made.filter("edge = 0").select("task", F.col("text").alias("following"))
    tasks = first.select("task", F.lead("task").over(Window.orderBy("task")).alias("next"), F.min("task").over(Window.partitionBy()).alias("lowest"))
    follows = tasks.select("task", F.coalesce("next", "lowest").alias("next"))
    last = made.filter("edge = 1").select("task", "doc_id", "text").join(follows, "task")
    last = last.join(first.withColumnRenamed("task", "next"), "next").select("doc_id", "text", "following").mapInArrow(_single, _COLUMNS)
    return made.filter("edge is null").select(*columns).union(last), made


def _bounds(radius: int, spread: int) -> list[int]:
    """Where the blocks of bits begin, and the end of the last."""
    count = max(_PARTS, radius // (spread + 1) + 1)
    return [k * BITS // count for k in range(count + 1)]


def _masks(width: int, spread: int) -> list[int]:
    """All changes of at most so many bits of a block."""
    return [sum(1 << k for k in bits) for size in range(spread + 1) for bits in itertools.combinations(range(width), size)]


def spread_for(radius: int, classes: int) -> int:
    """The bits in which a pair within the radius may differ in the block that leads its table: what costs an asked fingerprint least among so many classes."""

    def cost(spread: int) -> float:
        bounds = _bounds(radius, spread)
        width = BITS // (len(bounds) - 1)
        probes = sum(math.comb(width, size) for size in range(spread + 1))
        return (len(bounds) - 1) * probes * (PROBE_COST + classes / 2.0**width)

    return min(range(int(radius >= WIDE), MOST_SPREAD + 1), key=cost)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    total = np.zeros((len(a), len(b)), np.int16)
    for part in range(_PARTS):
        total += np.bitwise_count(a[:, None, part] ^ b[:, part])
    return total


def _met(radius: int, spread: int, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each row of _facing(): the fingerprints asked for, the others, and which are near, as places in both, in the first table where they meet."""

    def numbers(rows: pa.Array) -> np.ndarray:
        return np.stack([rows.field(f"f{i}").to_numpy(zero_copy_only=False).view(np.uint64) for i in range(_PARTS)], axis=1)

    for k, table in enumerate(batch.column("table").to_pylist()):
        a, b = numbers(batch.column("asked")[k].values), numbers(batch.column("others")[k].values)
        x, y = np.nonzero(_distances(a, b) <= radius)
        first = ~_meet(a[x] ^ b[y], radius, spread, table).any(axis=1)
        yield a, b, x[first], y[first]


def _compared(radius: int, spread: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each fingerprint asked for, how many documents of the others are near."""
    for batch in batches:
        keys, counts = [np.zeros((0, _PARTS), np.uint64)], [np.zeros(0, np.int64)]
        for k, (a, _, x, y) in enumerate(_met(radius, spread, batch)):
            weight = batch.column("others")[k].values.field("documents").to_numpy(zero_copy_only=False)
            near = np.bincount(x, weights=weight[y], minlength=len(a)).astype(np.int64)
            keys.append(a[near > 0])
            counts.append(near[near > 0])
        flat = np.concatenate(keys)
        yield pa.RecordBatch.from_arrays([*(pa.array(flat[:, i].view(np.int64)) for i in range(_PARTS)), pa.array(np.concatenate(counts))], names=[*(f"f{i}" for i in range(_PARTS)), "near"])


def _named(radius: int, spread: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The classes of each near pair, and the bits in which they differ."""
    names = ["fingerprint", "near_fingerprint", "bits"]
    for batch in batches:
        for a, b, x, y in _met(radius, spread, batch):
            for at in range(0, len(x), 65536):
                p, q = a[x[at : at + 65536]], b[y[at : at + 65536]]
                yield pa.RecordBatch.from_arrays([pa.array(_hex(p), pa.string()), pa.array(_hex(q), pa.string()), pa.array(np.bitwise_count(p ^ q).sum(axis=1).astype(np.int32))], names=names)


def _meet(differ: np.ndarray, radius: int, spread: int, tables: int) -> np.ndarray:
    """Whether pairs that differ in these bits meet in each of the first ``tables`` tables."""
    bits = np.unpackbits(np.ascontiguousarray(differ).view(np.uint8).reshape(len(differ), BITS // 8), axis=1, bitorder="little")
    before = np.concatenate([np.zeros((len(bits), 1), np.int64), np.cumsum(bits, axis=1, dtype=np.int64)], axis=1)
    return np.diff(before[:, _bounds(radius, spread)[: tables + 1]], axis=1) <= spread


def _block_columns(radius: int, spread: int) -> list[F.Column]:
    """The blocks of f0, f1, ... as long numbers."""
    out, bounds = [], _bounds(radius, spread)
    for low, high in zip(bounds, bounds[1:], strict=False):
        part, shift = divmod(low, 64)
        value = F.shiftrightunsigned(F.col(f"f{part}"), shift)
        if high > 64 * (part + 1):
            value = value.bitwiseOR(F.shiftleft(F.col(f"f{part + 1}"), 64 - shift))
        size = high - low
        out.append(value.bitwiseAND(F.lit((1 << size) - 1).cast("long")) if size < 64 else value)
    return out


def _facing(classes: DataFrame, radius: int, spread: int, scratch: common.Scratch) -> DataFrame:
    """table, asked, others: lists of at most about BLOCK classes that meet in a bucket, from classes (f0, f1, ..., documents, asked).

    A bucket's other classes are dealt into blocks, and those asked for go to each of these, so a large bucket is dealt
    over tasks as different buckets are. Short blocks have few values: then the buckets' sizes are broadcast.
    """
    key = [f"f{i}" for i in range(_PARTS)]
    blocks = F.posexplode(F.array(*_block_columns(radius, spread))).alias("table", "led")
    bounds = _bounds(radius, spread)
    flips = F.lit(_masks(int(max(np.diff(bounds))), spread)).cast("array<bigint>")
    others = classes.select(*key, "documents", blocks)
    asked = classes.filter("asked").select(*key, blocks).select(*key, "table", F.explode(F.transform(flips, lambda x: F.col("led").bitwiseXOR(x))).alias("led"))
    size = lambda df, name: df.groupBy("table", "led").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    sizes = scratch.table(size(others, "n_others").join(size(asked, "n_asked"), ["table", "led"]), "sizes")
    if (len(bounds) - 1) << int(max(np.diff(bounds))) <= BROADCAST_BUCKETS:
        sizes = F.broadcast(sizes)
    block = lambda n: F.pmod(F.xxhash64(*key), F.col(n))
    placed = asked.join(sizes, ["table", "led"]).select(*key, "table", "led", block("n_asked").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_others") - 1)).alias("block"))
    # dealt by what they are joined by, once
    questions = placed.repartition("table", "led", "block").groupBy("table", "led", "block", "part").agg(F.collect_list(F.struct(*key)).alias("asked"))
    placed = others.join(sizes, ["table", "led"]).withColumn("block", block("n_others"))
    answers = placed.groupBy("table", "led", "block").agg(F.collect_list(F.struct(*key, "documents")).alias("others"))
    return questions.join(answers, ["table", "led", "block"]).select("table", "asked", "others")


def _classes(fingerprinted: DataFrame, asked: F.Column, scratch: common.Scratch) -> DataFrame:
    classes = fingerprinted.groupBy(*(f"f{i}" for i in range(_PARTS))).agg(F.count(F.lit(1)).alias("documents"), F.max(F.coalesce(asked, F.lit(False))).alias("asked"))
    return scratch.table(classes, "classes")


def _searched(fingerprinted: DataFrame, asked: F.Column, radius: int, spread: int | None, scratch: common.Scratch) -> tuple[DataFrame, int]:
    classes = _classes(fingerprinted, asked, scratch)
    if spread is None:
        spread = spread_for(radius, classes.count())
    return _facing(classes, radius, spread, scratch), spread


def near(fingerprinted: DataFrame, asked: F.Column, *, radius: int = RADIUS, spread: int | None = None) -> DataFrame:
    """f0, f1, ... of the rows for which ``asked`` holds, and n_near: the documents whose fingerprints differ in at most ``radius`` bits, themselves among them.

    Equal fingerprints, of rows that repeat too, are one class; where asked is null a row isn't asked for. No rows
    give none. A bucket's classes are compared block against block inside the tasks, which give counts alone, so a
    bucket of any size is spread over tasks and makes no row for a pair. spread: see spread_for(), which gives it.
    """
    key = [f"f{i}" for i in range(_PARTS)]
    with common.scratch(fingerprinted.sparkSession) as scratch:
        facing, s = _searched(fingerprinted, asked, radius, spread, scratch)
        found = facing.mapInArrow(lambda b: _compared(radius, s, b), ", ".join(f"{k} long" for k in key) + ", near long")
        found = scratch.table(found.groupBy(*key).agg(F.sum("near").alias("n_near")), "near")
        scratch.keep(found)
        return found


def near_pairs(fingerprinted: DataFrame, asked: F.Column, *, radius: int = RADIUS, spread: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Which documents are near which: pairs of classes, and the classes' members.

    The first table has fingerprint, near_fingerprint and bits, once for each class with a row for which ``asked``
    holds and each other class within ``radius`` bits. The second has doc_id and fingerprint of every row: those of
    one fingerprint are a class, at no distance, so copies aren't expanded into pairs.
    """
    with common.scratch(fingerprinted.sparkSession) as scratch:
        facing, s = _searched(fingerprinted, asked, radius, spread, scratch)
        pairs = facing.mapInArrow(lambda b: _named(radius, s, b), "fingerprint string, near_fingerprint string, bits int").filter("bits > 0")
        pairs = scratch.table(pairs, "pairs")
        scratch.keep(pairs)
    name = F.concat(*(F.lower(F.lpad(F.hex(f"f{i}"), 16, "0")) for i in range(_PARTS)))
    return pairs, fingerprinted.select("doc_id", name.alias("fingerprint"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_near: for doc_id divisible by 20, how many other documents' fingerprints are within RADIUS bits; else null."""
    key = [f"f{i}" for i in range(_PARTS)]
    asked = F.col("doc_id") % 20 == 0
    with common.scratch(spark) as scratch:
        made, table = _with_next(common.load(spark, sf_dir, "documents"), scratch)
        rows = scratch.table(made, "fingerprinted")
        scratch.drop(table)
        scratch.keep(rows)
    found = near(rows, asked).toDF(*(f"_{k}" for k in key), "_near")
    same = F.lit(True)
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    rows = rows.join(found, same & F.coalesce(asked, F.lit(False)), "left")
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", (F.col("_near") - 1).alias("n_near"))
