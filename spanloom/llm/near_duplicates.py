"""7. Near duplicates: banded MinHash, odd sketches to verify candidates, full sets to confirm links.

Rows with equal shingle sets are one class. Classes that share a band's bucket are candidates:

1. each bucket's classes are compared with its least one alone, and the components of the confirmed links taken;
2. classes in buckets that still hold several components are dealt into blocks, by the fullest such bucket of each.
   Blocks that meet in a bucket are compared inside a task, all of one with all of the other that are in different
   components: by sketches, then, for the classes with a possible partner, by full sets. Only links that join
   components leave the task, so a pair never becomes a row.

So a bucket of one group costs as many comparisons as it has members, and no link between a bucket's members is
left unseen. A candidate is compared by odd sketches first: parities of the hashed MinHash samples, from whose
exclusive-or the number of samples that differ is estimated.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, components, statistics, words

#: Words of a shingle, and the least Jaccard similarity of a link, in percent.
SHINGLE, PERCENT = 4, 80
#: A pair at the least similarity of 0.8 shares no bucket with a probability of (1 - 0.8^ROWS)^BANDS = 3e-8.
BANDS, ROWS = 44, 5
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Sketches rule out a pair whose similarity they put below this: over six standard deviations below 0.8.
SKETCH_LEAST = 0.62
#: Classes in a block, about.
BLOCK = 256

_U = np.uint64
_A = (words.mix(np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)
_B = (words.mix(np.arange(1001, 1001 + SAMPLES, dtype=np.uint64)) >> _U(32)).astype(np.uint32)
_ROW = words.mix(np.arange(2001, 2001 + ROWS, dtype=np.uint64)) | _U(1)
_BAND = words.mix(np.arange(3001, 3001 + BANDS, dtype=np.uint64))
_SAMPLE = words.mix(np.arange(4001, 4001 + SAMPLES, dtype=np.uint64))


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text, the sorted hashes of its different shingles: of the whole text where it has fewer words."""
    for a, b, w in words.groups(column, lower=True):
        sums = words.sequences(w.hashes())
        first = w.first
        count = len(w.starts)
        start = np.arange(max(0, count - size + 1))
        runs = words.spans(sums, start, start + size)
        for k in range(b - a):
            lo, hi = int(first[k]), int(first[k + 1])
            if hi - lo >= size:
                yield np.unique(runs[lo : hi - size + 1])
            elif hi > lo:
                yield words.spans(sums, np.array([lo]), np.array([hi]))
            else:
                yield np.zeros(0, np.uint64)


def class_key(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def minhash(hashes: np.ndarray) -> np.ndarray:
    short = (hashes >> _U(32)).astype(np.uint32)
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(short), 1024):
        np.minimum(least, ((short[a : a + 1024, None] ^ _B) * _A).min(axis=0), out=least)
    return least


def bands_of(samples: np.ndarray) -> np.ndarray:
    """samples: a row for each set. The keys of their buckets, which hold the band's number."""
    parts = samples.reshape(len(samples), BANDS, ROWS).astype(np.uint64)
    return words.mix((words.mix(parts + _U(1)) * _ROW).sum(axis=2, dtype=np.uint64) + _BAND).view(np.int64)


def sketches_of(samples: np.ndarray) -> np.ndarray:
    """The odd sketches as SKETCH_BITS / 64 numbers each."""
    bits = (words.mix(samples.astype(np.uint64) + _SAMPLE) >> _U(40)).astype(np.int64) % SKETCH_BITS
    bits += np.arange(len(samples))[:, None] * SKETCH_BITS
    odd = (np.bincount(bits.ravel(), minlength=len(samples) * SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(samples), SKETCH_BITS), axis=1).view(np.int64)


#: The most bits in which the sketches of a pair differ that isn't ruled out.
MOST_BITS = int(SKETCH_BITS / 2 * (1 - math.exp(-2 / SKETCH_BITS * 2 * SAMPLES * (1 - SKETCH_LEAST))))


def estimate(bits: int) -> float:
    """The similarity at which sketches differ in so many bits."""
    return 1 + SKETCH_BITS * math.log(max(1e-9, 1 - 2 * bits / SKETCH_BITS)) / (4 * SAMPLES)


def _signatures(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes, keys = np.zeros(n, np.int64), np.zeros(n, np.int64)
        samples = np.zeros((n, SAMPLES), np.uint32)
        seen: dict[int, int] = {}
        for k, hashes in enumerate(shingle_sets(batch.column("text"), size)):
            sizes[k] = len(hashes)
            if len(hashes):
                keys[k] = class_key(hashes)
                same = seen.setdefault(int(keys[k]), k)
                samples[k] = minhash(hashes) if same == k else samples[same]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("doc_id", "k1", "k2")), pa.array(keys), pa.array(sizes), words.lists(bands_of(samples).ravel(), np.full(n, BANDS), pa.int64()), words.lists(sketches_of(samples).ravel(), np.full(n, SKETCH_BITS // 64), pa.int64())],
            names=["doc_id", "k1", "k2", "key", "n_shingles", "bands", "sketch"],
        )


def _sets(size: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text"), size))
        counts = np.array([len(x) for x in sets], np.int64)
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([class_key(x) for x in sets], pa.int64()), words.lists(flat, counts, pa.int64())], names=["key", "hashes"])


def _differing(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)


def _possible(n_a: Column, n_b: Column, percent: int) -> Column:
    return F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent


class _Side:
    """The classes of a block as arrays."""

    def __init__(self, rows: pa.StructArray, full: bool):
        self.keys, self.groups, self.sizes = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("key", "component", "n_shingles"))
        self.sketches = rows.field("sketch").flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(len(self.keys), -1)
        if full:
            hashes = rows.field("hashes")
            self.bounds = hashes.offsets.to_numpy().astype(np.int64)
            self.bounds -= self.bounds[0]
            self.hashes = hashes.flatten().to_numpy(zero_copy_only=False)

    def set_of(self, k: int) -> np.ndarray:
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]


def _possible_pairs(a: _Side, b: _Side, percent: int, most_bits: int) -> np.ndarray:
    """Which of a's rows with which of b's are in different components and neither too unlike in size nor by their sketches."""
    fits = (a.groups[:, None] != b.groups) & (np.minimum(a.sizes[:, None], b.sizes) * 100 >= np.maximum(a.sizes[:, None], b.sizes) * percent)
    x, y = np.nonzero(fits)
    for at in range(0, len(x), 32768):
        p, q = x[at : at + 32768], y[at : at + 32768]
        fits[p, q] = np.bitwise_count(a.sketches[p] ^ b.sketches[q]).sum(axis=1) <= most_bits
    return fits


def _involved(percent: int, most_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs of blocks (a, b, left, right): a, b, side and key of the classes with a possible partner on the other side."""
    for batch in batches:
        out: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for i in range(batch.num_rows):
            left, right = (_Side(batch.column(c)[i].values, False) for c in ("left", "right"))
            fits = _possible_pairs(left, right, percent, most_bits)
            keys = left.keys[fits.any(axis=1)], right.keys[fits.any(axis=0)]
            out.append((batch.column("a")[i].as_py(), batch.column("b")[i].as_py(), *keys))
        sizes = [len(x) + len(y) for *_, x, y in out]
        columns = [np.repeat(np.array([o[k] for o in out], np.int64), sizes) for k in (0, 1)]
        side = np.concatenate([np.repeat(np.array([0, 1], np.int32), [len(x), len(y)]) for *_, x, y in out] or [np.zeros(0, np.int32)])
        keys = np.concatenate([k for *_, x, y in out for k in (x, y)] or [np.zeros(0, np.int64)])
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(side), pa.array(keys)], names=["a", "b", "side", "key"])


def _intersections(a: _Side, b: _Side, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and sizes of the intersections of the pairs in ``fits``: one by one, or all at once as a product of matrices."""
    x, y = np.nonzero(fits)
    shingles, of = np.unique(np.concatenate([a.hashes, b.hashes]), return_inverse=True)
    one_by_one = float((a.sizes[x] + b.sizes[y]).sum()) * 20
    if one_by_one < len(a.keys) * len(b.keys) * len(shingles) * 0.1:
        return x, y, np.array([len(np.intersect1d(a.set_of(i), b.set_of(j), assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)], np.int64)
    total = np.zeros((len(a.keys), len(b.keys)), np.float64)
    rows = [np.repeat(np.arange(len(s.keys)), np.diff(s.bounds)) for s in (a, b)]
    parts = of[: len(a.hashes)], of[len(a.hashes) :]
    for low in range(0, len(shingles), 4096):
        m = []
        for s, row, part in zip((a, b), rows, parts, strict=True):
            some = (part >= low) & (part < low + 4096)
            m.append(np.zeros((len(s.keys), 4096), np.float32))
            m[-1][row[some], part[some] - low] = 1
        total += m[0] @ m[1].T
    return x, y, total[x, y].astype(np.int64)


def _linking(percent: int, most_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From pairs of blocks with full sets (left, right): links that join components, none within what those before it joined."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for i in range(batch.num_rows):
            left, right = (_Side(batch.column(c)[i].values, True) for c in ("left", "right"))
            x, y, common_ = _intersections(left, right, _possible_pairs(left, right, percent, most_bits))
            alike = common_ * 100 >= (left.sizes[x] + right.sizes[y] - common_) * percent
            above: dict[int, int] = {}
            for p, q in zip(x[alike].tolist(), y[alike].tolist(), strict=True):
                u, v = int(left.groups[p]), int(right.groups[q])
                while u in above:
                    u = above[u]
                while v in above:
                    v = above[v]
                if u != v:
                    above[max(u, v)] = min(u, v)
                    found.append((int(left.keys[p]), int(right.keys[q])))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["u", "v"])


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """u, v of the pairs (a, b) whose full sets are alike enough."""
    both = pairs.join(sets.select(F.col("key").alias("b"), F.col("hashes").alias("right")), "b").join(sets.select(F.col("key").alias("a"), F.col("hashes").alias("left")), "a")
    both = both.select("a", "b", (F.size("left") + F.size("right")).alias("sum"), F.size(F.array_intersect("left", "right")).alias("common"))
    return both.filter(F.col("common") * 100 >= (F.col("sum") - F.col("common")) * percent).select(F.col("a").alias("u"), F.col("b").alias("v"))


def linked(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT, sketches: bool = True) -> DataFrame:
    """doc_id, k1, k2 (the row, see common.row_key), n_shingles, component_id and kept of each row of ``docs`` (doc_id, text; other columns are left out).

    A null text and one without words have an empty set and are linked with nothing. Rows that repeat are linked
    and get equal results; no rows give none. A text of any length has its whole set, which one task holds at a time.
    A null doc_id is larger than any: component_id is null only where all of its rows' are. The result reads from
    tables in the shared folder. Without ``sketches`` candidates go to their full sets at once, whatever these say.
    """
    with common.scratch(docs.sparkSession) as scratch, common.held(docs.sparkSession):
        result, tables = _linked(docs, shingle, percent, MOST_BITS if sketches else SKETCH_BITS, scratch)
        for table in tables:
            scratch.keep(table)
        return result


def _linked(docs: DataFrame, shingle: int, percent: int, most_bits: int, scratch: common.Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """What linked() returns, and the tables that it reads from."""
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *common.row_key(F.col("doc_id"), text))
    signed = rows.mapInArrow(lambda b: _signatures(shingle, b), "doc_id long, k1 long, k2 long, key long, n_shingles long, bands array<long>, sketch array<long>")
    signed = scratch.table(signed, "signatures")
    slim = signed.select("doc_id", "k1", "k2", "key", "n_shingles")
    filled = signed.filter("n_shingles > 0")

    # buckets with more than one class, and the classes in them
    placed = filled.select("key", F.explode("bands").alias("band"))
    shared = placed.groupBy("band").agg(F.min("key").alias("leader"), F.max("key").alias("last")).filter("leader <> last").select("band", "leader")
    members = scratch.table(placed.join(shared, "band").select("band", "leader", "key").distinct(), "buckets")
    involved = members.select("key").distinct()
    sketched = filled.join(involved, "key", "left_semi").groupBy("key").agg(F.min_by(F.struct("n_shingles", "sketch", "k1", "k2"), F.struct("k1", "k2")).alias("of")).select("key", "of.*")
    sketched = scratch.table(sketched, "sketches")
    wanted = sketched.select("k1", "k2")
    sets = rows.join(wanted, ["k1", "k2"], "left_semi").select("text").mapInArrow(lambda b: _sets(shingle, b), "key long, hashes array<long>")
    sets = scratch.table(sets.groupBy("key").agg(F.first("hashes").alias("hashes")), "sets")

    right = sketched.select(F.col("key").alias("b"), F.col("n_shingles").alias("n_b"), F.col("sketch").alias("sketch_b"))
    left = sketched.select(F.col("key").alias("a"), F.col("n_shingles").alias("n_a"), F.col("sketch").alias("sketch_a"))
    pairs = members.filter("key <> leader").select(F.col("leader").alias("a"), F.col("key").alias("b")).distinct()
    pairs = pairs.join(right, "b").join(left, "a").filter(_possible(F.col("n_a"), F.col("n_b"), percent) & (_differing(F.col("sketch_a"), F.col("sketch_b")) <= most_bits))
    links = scratch.table(_confirmed(pairs.select("a", "b"), sets, percent), "links")
    found = components.components(links)

    # classes in buckets of several components, in blocks by their fullest such bucket
    grouped = members.join(found.withColumnRenamed("node", "key"), "key", "left").select("band", "key", F.coalesce("component", "key").alias("component"))
    grouped = scratch.table(grouped, "grouped")
    scratch.drop(members)
    sizes = grouped.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("band", "n")
    sizes = scratch.table(sizes, "sizes")
    open_ = scratch.table(grouped.join(sizes, "band"), "open")
    scratch.drop(grouped, sizes)
    place = open_.groupBy("key", "component").agg(F.max(F.struct("n", "band")).alias("of"))
    canopies = place.groupBy("of").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    block = F.xxhash64("of.band", F.pmod(F.xxhash64("key"), F.col("blocks")))
    place = scratch.table(place.join(canopies, "of").select("key", "component", block.alias("block")), "places")
    meet = open_.select("band", "key").join(place.select("key", "block"), "key").select("band", "block").distinct()
    meet = meet.select("band", F.col("block").alias("a")).join(meet.select("band", F.col("block").alias("b")), "band").filter("a <= b").select("a", "b").distinct()
    meet = scratch.table(meet, "meetings")
    described = place.join(sketched.select("key", "n_shingles", "sketch"), "key")
    blocks = described.groupBy("block").agg(F.collect_list(F.struct("key", "component", "n_shingles", "sketch")).alias("classes"))
    facing = meet.join(blocks.toDF("a", "left"), "a").join(blocks.toDF("b", "right"), "b")
    involved = facing.mapInArrow(lambda b: _involved(percent, most_bits, b), "a long, b long, side int, key long")
    full = involved.join(described, "key").join(sets, "key").groupBy("a", "b", "side").agg(F.collect_list(F.struct("key", "component", "n_shingles", "sketch", "hashes")).alias("classes"))
    full = scratch.table(full, "facing")
    facing = full.filter("side = 0").select("a", "b", F.col("classes").alias("left")).join(full.filter("side = 1").select("a", "b", F.col("classes").alias("right")), ["a", "b"])
    more = scratch.table(facing.select("left", "right").mapInArrow(lambda b: _linking(percent, most_bits, b), "u long, v long"), "links")
    found = components.components(links.union(more))
    scratch.drop(open_, place, meet, full, sketched, sets, links, more)

    # each class's component and the least doc_id in it, class by class, and then the rows'
    least = slim.filter("n_shingles > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    of = scratch.table(least.join(found.withColumnRenamed("node", "key"), "key", "left").select("key", "least", F.coalesce("component", "key").alias("component")), "classes")
    least = scratch.table(of.groupBy("component").agg(F.min("least").alias("component_id")), "leasts")
    result = slim.join(of.select("key", "component"), "key", "left").join(least, "component", "left")
    result = result.select("doc_id", "k1", "k2", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return result.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), [signed, of, least]


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(common.load(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that are kept: of each component that with the least doc_id, of rows that repeat any one of them."""
    names = [statistics.fresh(docs, c) for c in ("k1", "k2", "copies")]
    with common.scratch(spark) as scratch, common.held(spark):
        verdicts, _ = _linked(docs, SHINGLE, PERCENT, MOST_BITS, scratch)
        verdicts = scratch.table(verdicts.filter("kept").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies")), "kept")
        scratch.keep(verdicts)
    k1, k2 = common.row_key(F.col("doc_id"), F.col("text").cast("string"))
    rows = docs.select("*", k1.alias(names[0]), k2.alias(names[1])).join(verdicts.toDF(*names), names[:2])
    once = rows.filter(F.col(names[2]) == 1)
    again = rows.filter(F.col(names[2]) > 1).dropDuplicates(names[:2])
    return once.union(again).select(*(F.col(f"`{c}`") for c in docs.columns))


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents),
e AS (SELECT doc_id, unnest(CASE WHEN len(l) = 0 THEN [] WHEN len(l) < 4 THEN [array_to_string(l, ' ')] ELSE list_distinct(list_transform(range(1, len(l) - 2), lambda i: array_to_string(l[i:i + 3], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM e GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x),
low AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, low.y AS component_id, d.doc_id = low.y AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN low ON low.x = d.doc_id
"""
