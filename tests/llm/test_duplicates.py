"""2, 4 and 7 against comparisons of everything with everything."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from spanloom import shared
from spanloom.llm import common, components, fingerprints, near_duplicates, substring_dedup, words

from . import brute
from .conftest import CLASHING, EDGES, SCHEMA, passage, rows_of


def test_words_and_hashes():
    texts = ["", None, "a b", "  a\tb  ", "é a\x0bb", "b a", "word" * 400_000, "a b"]
    split = {}
    for a, b, w in words.groups(pa.array(texts)):
        h = w.hashes()
        for k in range(b - a):
            split[a + k] = h[w.first[k] : w.first[k + 1]].tolist()
    assert [len(split[k]) for k in range(len(texts))] == [len(brute.words(t)) for t in texts]
    assert split[2] == split[3] == split[7] == split[4][1:] and split[5] == split[2][::-1]


def test_substring_dedup(spark, sf, small):
    want = brute.without_repeats([t for _, t in small[1]])
    got = sorted(substring_dedup.op2_substring_dedup(spark, sf).collect())
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got] == [(i, n, gone, brute.sha(kept)) for (i, _), (n, gone, kept) in zip(small[1], want, strict=True)]
    assert sum(r.n_removed for r in got) > 0


def test_substring_dedup_edges(spark, edges, nothing):
    want = brute.without_repeats([t for _, t in EDGES])
    got = substring_dedup.without_repeats(edges).collect()
    key = lambda x: (str(x[0]), *x[1:])
    assert sorted(((r.row.doc_id, r.cut.n_words, r.cut.n_removed, r.cut.sha256) for r in got), key=key) == sorted(((i, n, gone, brute.sha(kept)) for (i, _), (n, gone, kept) in zip(EDGES, want, strict=True)), key=key)
    assert {r.row.doc_id: [(x.start, x.end) for x in r.cut.repeats] for r in got}[13] == [(3, 43)]
    out = substring_dedup.stage(spark, edges, "")
    assert out.columns == edges.columns and out.count() == len(EDGES)
    texts = {r.doc_id: r for r in out.collect()}
    assert texts[8].text == dict(EDGES)[8] and texts[2].text is None and texts[5].text == "" and texts[5].n_chars == 0
    assert substring_dedup.without_repeats(nothing).count() == 0


@pytest.mark.parametrize("length", [35, 135, 400])
def test_long_windows(spark, length):
    """Reaches of more windows than a byte counts."""
    shared = passage(900, 61)
    rows = [(1, shared + " " + passage(50, 62)), (2, passage(20, 63) + " " + shared), (3, passage(length - 1, 61)), (4, passage(length, 61)), (5, passage(1000, 64))]
    want = brute.without_repeats([t for _, t in rows], length)
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).collect()
    assert sorted((r.row.doc_id, r.cut.n_words, r.cut.n_removed, r.cut.sha256) for r in got) == [(i, n, gone, brute.sha(kept)) for (i, _), (n, gone, kept) in zip(rows, want, strict=True)]


def test_very_many_equal_rows(spark):
    """10,000 rows that are the same, without a doc_id: what is found for them is one row, no longer than one text."""
    same, once = passage(80, 51), passage(60, 52)
    rows = [(None, same)] * 10_000 + [(1, once), (2, "x " + same), (None, once.upper())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    with common.scratch(spark) as scratch:
        found = substring_dedup.repeats(df, scratch).collect()
    assert len(found) == 2 and all(len(r.found) <= 80 for r in found)
    cut = substring_dedup.without_repeats(df)
    assert sorted({(str(r.row.doc_id), r.cut.n_words, r.cut.n_removed) for r in cut.collect()}) == sorted({("None", 80, 80), ("1", 60, 0), ("2", 81, 80), ("None", 60, 0)})
    kept = near_duplicates.linked(df).groupBy("doc_id", "kept").count().collect()
    assert {(r.doc_id, r.kept): r["count"] for r in kept} == {(None, False): 10_001, (1, True): 1, (2, True): 1}
    assert sorted(r.doc_id for r in near_duplicates.stage(spark, df, "").collect()) == [1, 2]


def test_rows_have_keys_of_their_own(spark):
    """Texts whose 32-bit hashes are equal, under one doc_id or none, are different rows."""
    hashes = {}
    pairs = []
    for r in spark.range(200_000).selectExpr("cast(id as string) as t").selectExpr("t", "hash(t) as h").collect():
        if r.h in hashes:
            pairs.append((hashes[r.h], r.t))
        hashes[r.h] = r.t
    assert pairs
    texts = [t for pair in pairs for t in pair]
    for doc_id in (None, 5):
        df = spark.createDataFrame([(doc_id, t) for t in [*texts, texts[0]]], "doc_id long, text string")
        keys = df.select(*common.row_key(df.doc_id, df.text)).distinct().count()
        assert keys == len(texts)


def test_passages_meet_at_their_ends(spark):
    """Overlapping repeats, shared starts and ends, repeats within one text, and windows one word too short."""
    a, b, c = passage(60, 21), passage(60, 22), passage(34, 23)
    texts = [a + " " + b, "x " + " ".join(a.split()[10:]) + " " + " ".join(b.split()[:20]) + " y", b + " z " + b, c + " p", "q " + c, " ".join(a.split()[:35]), " ".join(a.split()[25:]) + " t"]
    texts += [f"{s} {a} {s}" for s in map(str, range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.row.doc_id: (r.cut.n_words, r.cut.n_removed, r.cut.sha256) for r in substring_dedup.without_repeats(df).collect()}
    for i, (n, gone, kept) in enumerate(brute.without_repeats(texts)):
        assert got[i] == (n, gone, brute.sha(kept)), i


def linked_as(rows, got):
    """doc_id, n_shingles and component of each row, as counted."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    tops, sets = brute.components(rows)
    want = sorted(((i, len(s), rows[t][0], i == rows[t][0]) for (i, _), t, s in zip(rows, tops, sets, strict=True)), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got), key=str) == want


def test_near_duplicates(spark, sf, small):
    linked_as(small[1], near_duplicates.op7_near_duplicates(spark, sf).collect())


def test_near_duplicates_edges(spark, edges, nothing):
    linked_as(EDGES, near_duplicates.linked(edges).collect())
    out = near_duplicates.stage(spark, edges, "")
    assert out.columns == edges.columns
    kept = sorted(str(r.doc_id) for r in out.collect())
    assert kept == sorted(["1", "2", "None", "3", "4", "5", "7", "8", "9", "10", "12", "13", "14", "15", "16", "None", "18"])
    assert near_duplicates.linked(nothing).count() == 0


def test_chains_of_near_copies(spark):
    """A group in which many aren't linked to its first, and some are linked with none."""
    rng = np.random.default_rng(3)
    base = passage(150, 31).split()
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.choice(len(w), int(rng.integers(0, 14)), replace=False):
            w[at] = f"e{rng.integers(10**9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked_as(rows, near_duplicates.linked(df).collect())
    linked_as(rows, near_duplicates.linked(df, sketches=False).collect())


def test_sketches_estimate():
    rng = np.random.default_rng(5)
    for share in (0.75, 0.9):
        n = 2000
        both = rng.integers(0, 2**63, int(n * share), dtype=np.uint64)
        sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)])) for _ in range(2)]
        a, b = near_duplicates.sketches_of(np.array([near_duplicates.minhash(s) for s in sets]))
        bits = int(np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)).sum())
        true = len(np.intersect1d(*sets)) / len(np.union1d(*sets))
        assert near_duplicates.estimate(bits) == pytest.approx(true, abs=0.12)


def test_pairs_at_the_least_similarity_are_candidates():
    """Random pairs at a similarity of exactly 0.8, with unions of 5 to 400 shingles: each shares a bucket, and no sketch rules it out."""
    rng = np.random.default_rng(11)
    n_pairs = 0
    for fifths in (1, 2, 4, 10, 20, 40, 80):
        left, right = [], []
        for _ in range(300):
            union = rng.integers(0, 2**63, 5 * fifths, dtype=np.uint64)
            cut = int(rng.integers(0, fifths + 1))
            left.append(near_duplicates.minhash(np.sort(union[: 4 * fifths + cut])))
            right.append(near_duplicates.minhash(np.sort(np.concatenate([union[: 4 * fifths], union[4 * fifths + cut :]]))))
        left, right = np.array(left), np.array(right)
        assert (near_duplicates.bands_of(left) == near_duplicates.bands_of(right)).any(axis=1).all()
        differ = np.bitwise_count(near_duplicates.sketches_of(left).view(np.uint64) ^ near_duplicates.sketches_of(right).view(np.uint64)).sum(axis=1)
        assert (differ <= near_duplicates.MOST_BITS).all()
        n_pairs += len(left)
    assert n_pairs == 2100


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (5, 4), (3, 1), *((i, i + 1) for i in range(20, 60)), (10, 11), (10, 11)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 1, 3: 1, 8: 7, 5: 4, 11: 10} | {i: 20 for i in range(21, 61)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_leftovers_are_released(spark):
    found = components.components(spark.createDataFrame([(1, 2)], "u long, v long"))
    assert found.count() == 1
    shared.release(spark)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist|PATH_NOT_FOUND"):
        found.collect()


def test_fingerprints(spark, sf, small):
    got = {r.doc_id: r for r in fingerprints.op4_fingerprints(spark, sf).collect()}
    texts = [t for _, t in small[1]]
    own = fingerprints.fingerprints(pa.array(texts))
    for k, (i, t) in enumerate(small[1]):
        r, nxt = got[i], (k + 1) % len(texts)
        changed = t[: len(t) - len(t) // 4] + texts[nxt][: len(t) // 4]
        other = fingerprints.fingerprints(pa.array([changed]))[0]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{int(x):016x}" for x in own[k])
        assert r.near_edited == float(fingerprints.likeness(own[k], other)) and r.near_next == float(fingerprints.likeness(own[k], own[nxt]))
        near = int((np.bitwise_count(own ^ own[k]).sum(axis=1) <= fingerprints.RADIUS).sum()) - 1
        assert r.n_near == (near if i % 20 == 0 else None)
    apart = [r for r in got.values() if r.n_chars > 100]
    assert np.mean([r.near_edited > r.near_next for r in apart]) > 0.98


@pytest.mark.parametrize("radius", [3, 7, 10])
def test_all_within_the_radius(spark, radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (5, 4), dtype=np.int64)
    rows = []
    for k in range(400):
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(256, int(rng.integers(0, 9)), replace=False)] = 1
        rows.append(base[k % 5] ^ np.packbits(bits).view(np.int64))
    rows = np.array(rows)
    df = spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(rows)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    got = {tuple(r)[:4]: r.n_near for r in fingerprints.near(df, df.doc_id % 4 == 0, radius=radius).collect()}
    assert len(got) == len({tuple(r) for r in rows[::4].tolist()})
    for r in rows[::4]:
        assert got[tuple(r.tolist())] == (np.bitwise_count(rows.view(np.uint64) ^ r.view(np.uint64)).sum(axis=1) <= radius).sum()


def test_near_copies_are_found(spark):
    """Texts with some words replaced, at five-word similarities of 0.8 and more: found, and as many as brute force finds."""
    rng = np.random.default_rng(9)
    texts = []
    for k in range(60):
        w = passage(300, 700 + k).split()
        v = list(w)
        for at in rng.choice(len(w), 1 + k % 6, replace=False):
            v[at] = f"new{rng.integers(10**6)}"
        a, b = (brute.shingles(" ".join(x), 5) for x in (w, v))
        assert len(a & b) / len(a | b) >= 0.8
        texts += [" ".join(w), " ".join(v)]
    prints = fingerprints.fingerprints(pa.array(texts))
    df = spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(prints.view(np.int64))], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    got = {tuple(r)[:4]: r.n_near for r in fingerprints.near(df, df.doc_id % 2 == 0).collect()}
    differ = np.bitwise_count(prints[:, None] ^ prints).sum(axis=2)
    assert [got[tuple(r)] for r in prints.view(np.int64)[::2].tolist()] == (differ <= fingerprints.RADIUS).sum(axis=1)[::2].tolist()
    assert (differ[np.arange(0, 120, 2), np.arange(1, 120, 2)] <= fingerprints.RADIUS).mean() > 0.98


@pytest.mark.parametrize(("radius", "spread"), [(0, None), (16, None), (23, 2), (39, None), (39, 2), (39, 3), (40, None)])
def test_all_within_a_wide_radius(spark, radius, spread):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (5, 4), dtype=np.int64)
    rows = []
    for k in range(400):
        bits = np.zeros(256, np.uint8)
        bits[rng.choice(256, int(rng.integers(0, radius * 3 // 4 + 2)), replace=False)] = 1
        rows.append(base[k % 5] ^ np.packbits(bits).view(np.int64))
    rows = np.array(rows)
    df = spark.createDataFrame([(k, *map(int, r)) for k, r in enumerate(rows)], "doc_id long, f0 long, f1 long, f2 long, f3 long")
    got = {tuple(r)[:4]: r.n_near for r in fingerprints.near(df, df.doc_id % 4 == 0, radius=radius, spread=spread).collect()}
    want = {tuple(r.tolist()): (np.bitwise_count(rows.view(np.uint64) ^ r.view(np.uint64)).sum(axis=1) <= radius).sum() for r in rows[::4]}
    assert got == want and any(1 < n < 60 for n in want.values())


def test_buckets_stay_small_as_classes_grow():
    """At a radius of 39: the comparisons that an asked fingerprint takes grow far less than the classes, a thousandfold here."""
    work = []
    for classes in (10**6, 10**9):
        spread = fingerprints.spread_for(39, classes)
        bounds = fingerprints._bounds(39, spread)
        work.append(sum(len(fingerprints._masks(b - a, spread)) * (1 + classes / 2 ** (b - a)) for a, b in zip(bounds, bounds[1:], strict=False)))
        # the pigeonhole: 39 bits over the blocks leave one with no more than the spread
        assert (len(bounds) - 1) * (spread + 1) > 39
    assert fingerprints.spread_for(39, 10**4) == 1 and fingerprints.spread_for(39, 10**9) == 3 and work[1] < 40 * work[0]


def test_near_copies_are_named(spark, sf, small):
    """Pairs of classes with their members give the very documents that brute force finds."""
    made = fingerprints.with_next(small[0])
    pairs, members = (t.collect() for t in fingerprints.near_pairs(made, made.doc_id % 3 == 0))
    of = {}
    for r in members:
        of.setdefault(r.fingerprint, []).append(r.doc_id)
    own = {i: k for k, v in of.items() for i in v}
    prints = fingerprints.fingerprints(pa.array([t for _, t in small[1]]))
    ids = [i for i, _ in small[1]]
    assert own == dict(zip(ids, fingerprints._hex(prints), strict=True))
    near = {}
    for r in pairs:
        near.setdefault(r.fingerprint, []).append((r.near_fingerprint, r.bits))
    for i, row in zip(ids, prints, strict=True):
        if i % 3 == 0:
            differ = np.bitwise_count(prints ^ row).sum(axis=1)
            got = [(j, bits) for other, bits in [(own[i], 0), *near.get(own[i], [])] for j in of[other]]
            assert sorted(got) == [(j, int(d)) for j, d in zip(ids, differ, strict=True) if d <= fingerprints.RADIUS]
    assert any(bits for v in near.values() for _, bits in v) and len(of) < len(ids)


def test_fingerprints_edges(spark, edges, nothing):
    got = fingerprints.with_next(edges).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in EDGES)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0 and by[1].fingerprint == by[2].fingerprint
    assert fingerprints.with_next(nothing).count() == 0
    single = fingerprints.with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert single.near_next == 1.0 and single.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()


def test_many_copies(spark):
    """A third of the rows are one text; another third one passage in different ones."""
    rows = [(i, passage(40, 41)) for i in range(300)] + [(300 + i, f"u{i} {passage(50, 42)} v{i} " + passage(30, 100 + i)) for i in range(300)] + [(600 + i, passage(60, 500 + i)) for i in range(300)]
    df = spark.createDataFrame(rows_of(rows), SCHEMA).repartition(7)
    got = {r.row.doc_id: r.cut for r in substring_dedup.without_repeats(df).collect()}
    assert all(got[i].n_removed == 40 for i in range(300)) and all(got[300 + i].n_removed == 50 for i in range(300)) and all(got[600 + i].n_removed == 0 for i in range(300))
    kept = sorted(r.doc_id for r in near_duplicates.linked(df).filter("kept").collect())
    assert kept == [0, *range(300, 900)]
    assert common.made() > 0 and CLASHING[0] in df.columns
