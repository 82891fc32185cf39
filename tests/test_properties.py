"""Folds over random spans, ties included, against plain Python."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.operators import containment, evaluate, intervals, resolve, supervise

LABELS = ["A", "B", "C"]


def documents(seed, n=150):
    rng = random.Random(seed)
    out = {}
    for d in range(n):
        spans = []
        for k in range(rng.randrange(1, 12)):
            start = rng.randrange(60)
            spans.append((start, start + rng.randrange(1, 15), rng.choice(LABELS), rng.randrange(1, 10) / 10, k))
        out[d] = spans
    return out


def frame(spark, docs):
    return spark.createDataFrame([(d, *s) for d, spans in docs.items() for s in spans], "doc_id long, start long, end long, label string, score double, ord long")


def grouped(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append((r.start, r.end, r.label, r.score))
    return {d: sorted(v) for d, v in out.items()}


def apart(a, b):
    return max(a[0], b[0]) >= min(a[1], b[1])


def chosen(spans, order, free):
    kept = []
    for s in sorted(spans, key=order):
        if all(free(k, s) for k in kept):
            kept.append(s)
    return kept


@pytest.mark.parametrize("seed", [1, 2])
def test_non_overlapping(spark, seed):
    docs = documents(seed)
    want = {d: sorted(s[:4] for s in chosen(v, lambda s: (-s[3], s[0] - s[1], s[0], s[1], s[2]), apart)) for d, v in docs.items()}
    assert grouped(resolve.non_overlapping(frame(spark, docs), "doc_id")) == want


@pytest.mark.parametrize("iou", [0.5, 0.0])
def test_suppressed(spark, iou):
    docs = documents(3)

    def free(a, b):
        common = max(0, min(a[1], b[1]) - max(a[0], b[0]))
        return apart(a, b) and common / (a[1] - a[0] + b[1] - b[0] - common) < iou

    want = {d: sorted(s[:4] for s in chosen(v, lambda s: (-s[3], s[4]), free)) for d, v in docs.items()}
    assert grouped(resolve.suppressed(frame(spark, docs), "doc_id", iou)) == want


@pytest.mark.parametrize("cross", [0.7, None])
def test_suppressed_by_label(spark, cross):
    docs = documents(4)

    def ratio(a, b):
        return max(0, min(a[1], b[1]) - max(a[0], b[0])) / min(a[1] - a[0], b[1] - b[0])

    want = {}
    for d, spans in docs.items():
        pool = []
        for label in dict.fromkeys(s[2] for s in spans):
            pool += chosen([s for s in spans if s[2] == label], lambda s: (-s[3], s[4]), lambda a, b: ratio(a, b) <= 0.35)
        if cross is not None:
            pool = chosen(list(pool), lambda s: -s[3], lambda a, b: ratio(a, b) <= cross)
        want[d] = sorted(s[:4] for s in pool)
    assert grouped(resolve.suppressed_by_label(frame(spark, docs), "doc_id", cross=cross)) == want


def related(pred, gold):
    """(kind, predicted, gold) as the operator's docstring has it."""
    both = pred & gold
    out = [("tp", x, x) for x in both]
    pool = gold - both
    for x in sorted(pred - both):
        ranked = []
        for y in pool:
            kind = 0 if x[1] == y[1] and x[0] != y[0] else 1 if x[1] and x[1] in y[1] and x[1] != y[1] else 2 if y[1] and y[1] in x[1] and x[1] != y[1] else 9
            if kind < 9:
                ranked.append((kind, x[0] != y[0], abs(len(x[1]) - len(y[1])), *y))
        if ranked:
            kind, *_, label, value = min(ranked)
            pool.remove((label, value))
            out.append((("mismatch", "subset", "superset")[kind], x, (label, value)))
        else:
            out.append(("fp", x, None))
    return sorted([*out, *(("fn", None, y) for y in pool)], key=str)


def test_relationships(spark):
    rng = random.Random(6)
    words = ["a", "ab", "abc", "b", "bc", "", "x y", "x"]
    sides = [{d: {(rng.choice(LABELS), rng.choice(words)) for _ in range(rng.randrange(6))} for d in range(200)} for _ in range(2)]
    frames = [spark.createDataFrame([(d, *x) for d, v in side.items() for x in v], "doc_id long, label string, value string") for side in sides]
    got = defaultdict(list)
    for r in evaluate.relationships(*frames, "doc_id").collect():
        pair = lambda a, b: None if a is None else (a, b)
        got[r.doc_id].append((r.kind, pair(r.pred_label, r.pred_value), pair(r.gold_label, r.gold_value)))
    for d in range(200):
        assert sorted(got.get(d, []), key=str) == related(sides[0][d], sides[1][d]), d


def test_disjoint_and_bounded(spark):
    """Kept spans never overlap; credit is at most the smaller side."""
    docs = documents(7)
    df = frame(spark, docs)
    for spans in grouped(resolve.non_overlapping(df, "doc_id")).values():
        assert all(apart(a, b) for i, a in enumerate(spans) for b in spans[:i])
    side = df.select("doc_id", "label", F.col("start").alias("ts"), (F.col("end") - 1).alias("te"), "ord")
    pairs = evaluate.credit_pairs(side.withColumnRenamed("ord", "pi").filter("pi < 5"), side.withColumnRenamed("ord", "gi").filter("gi > 2"), "doc_id", False)
    for r in evaluate.total_credit(pairs, "doc_id").collect():
        n = len(docs[r.doc_id])
        assert 0 < r.credit <= min(5, n, max(0, n - 3)) + 1e-9 and r.pairs <= min(5, n - 3)


def test_budgets(spark):
    """Each document keeps its positives, and negatives by its budget."""
    rng = random.Random(8)
    rows = [(d, i, rng.random() < 0.1 * (d % 3), rng.random() < 0.5) for d in range(20) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, i long, positive boolean, hard boolean")
    got = defaultdict(list)
    for r in supervise.budgeted_negatives(df, "doc_id", "positive", "hard", F.col("i"), without=7).collect():
        got[r.doc_id].append(r)
    for d in range(20):
        mine = [r for r in rows if r[0] == d]
        n = sum(r[2] for r in mine)
        negatives = [r for r in got[d] if not r.positive]
        assert sum(r.positive for r in got[d]) == n
        if n == 0:
            assert sorted(r.i for r in negatives) == sorted(r[1] for r in mine)[:7]
        else:
            for hard, each in ((True, 2), (False, 6)):
                assert sum(r.hard == hard for r in negatives) == min(each * n, sum(not r[2] and r[3] == hard for r in mine))


@pytest.mark.parametrize(("kind", "bound"), [("disjoint", None), ("apart", 0.35), ("apart", 0.7), ("apart", 0.0), ("apart", 1.0), ("apart", -0.1)])
def test_intervals_against_all_kept(kind, bound):
    """Two searches decide as comparing with every span kept does, empty spans too."""
    rng = random.Random(str(kind) + str(bound))
    for _ in range(300):
        spans = [(s := rng.randrange(30), s + rng.randrange(0, 25)) for _ in range(rng.randrange(30))]

        def clash(a, b):
            common = max(0, min(a[1], b[1]) - max(a[0], b[0]))
            if kind == "disjoint":
                return common > 0
            return (common / min(a[1] - a[0], b[1] - b[0]) if common else 0) > bound

        taker = intervals.Disjoint() if kind == "disjoint" else intervals.Apart(bound)
        got, kept = [], []
        for s in spans:
            got.append(taker.take(*s))
            free = not any(clash(k, s) for k in kept)
            kept += [s] if free else []
            assert got[-1] == free


def test_a_hundred_thousand_spans_in_a_document(spark):
    df = spark.range(100_000).select(F.lit(1).alias("doc_id"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 7).alias("end"), F.when(F.col("id") % 3 == 0, "A").otherwise("B").alias("label"), (F.pmod(F.hash("id"), F.lit(1000)) / 1000).alias("score"), F.col("id").alias("ord"))
    begun = time.monotonic()
    assert resolve.non_overlapping(df, "doc_id").count() > 40_000
    assert resolve.suppressed(df, "doc_id").count() > 40_000
    assert resolve.suppressed_by_label(df, "doc_id").count() == 100_000
    assert time.monotonic() - begun < 60


def test_relations_by_automaton(monkeypatch):
    """The automaton finds what comparing all values finds, nulls and empty values among them."""
    rng = random.Random(9)
    monkeypatch.setattr(containment, "_FEW", 0)
    words = ["a", "ab", "abc", "b", "bc", "", "x y", "x", "é", "éa", "cab", "abab"]
    for _ in range(500):
        sides = [{(rng.choice(LABELS), rng.choice(words)) for _ in range(rng.randrange(9))} for _ in range(2)]
        got = sorted(((k, None if p is None and v is None else (p, v), None if g is None and w is None else (g, w)) for k, p, v, g, w in containment.related(*sides)), key=str)
        assert got == related(*sides)
    assert sorted(containment.related({(None, "a"), ("A", None)}, {("A", "ab"), ("A", None)}), key=str) == sorted([("tp", "A", None, "A", None), ("subset", None, "a", "A", "ab")], key=str)


def test_ten_thousand_values_a_side():
    rng = random.Random(10)
    value = lambda n: "".join(rng.choices("abcdefgh", k=n))
    gold = {("A", value(rng.randrange(6, 10))) for _ in range(10_000)}
    pred = {("B", v + value(3)) for _, v in list(gold)[:5000]} | {("A", value(8)) for _ in range(5000)}
    begun = time.monotonic()
    assert sum(r[0] == "superset" for r in containment.related(pred, gold)) > 4000
    assert time.monotonic() - begun < 10


def test_meeting_spans():
    """The sweep finds what comparing all pairs finds; 100,000 spans a side that hardly overlap take a second."""
    rng = random.Random(11)
    for _ in range(300):
        sides = [[(s := rng.randrange(20), s + rng.randrange(0, 8)) for _ in range(rng.randrange(9))] for _ in range(2)]
        want = {(i, j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1]) if max(a[0], b[0]) < min(a[1], b[1])}
        got = intervals.meeting(*sides)
        assert set(got) == want and len(got) == len(want)
        empty = {(i, j) for i, a in enumerate(sides[0]) for j, b in enumerate(sides[1]) if a == b and a[0] == a[1]}
        assert set(intervals.meeting(*sides, True)) == want | empty
    many = [(7 * k, 7 * k + 5) for k in range(100_000)]
    begun = time.monotonic()
    assert len(intervals.meeting(many, [(s + 3, e + 3) for s, e in many])) == 199_999
    assert time.monotonic() - begun < 5
