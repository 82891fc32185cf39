"""Spans on tokens in the row against plain readings of the texts."""

import random
import sys
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from spanloom.operators import detect, tokens

PATTERN = regex.compile(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t\n\x0b\f\r]")
ROW = "doc_id long, text string, spans array<struct<start:bigint,end:bigint>>"


def made(n=200, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = rng.choice([None, ""]) if i % 20 == 0 else "".join(rng.choice("ab é_-.\t\n  \U0001f600日") for _ in range(rng.randrange(50)))
        size = len(text or "")
        spans = [(rng.randrange(-2, size + 3), rng.randrange(-2, size + 3)) for _ in range(rng.randrange(6))]
        rows.append((i, text, None if i % 31 == 5 else [(None, 3) if rng.random() < 0.05 else s for s in spans]))
    return rows


def toks(text):
    return [m.span() for m in PATTERN.finditer(text or "")]


def overlapping(text, s, e):
    hit = [k for k, (a, b) in enumerate(toks(text)) if max(a, s) < min(b, e)]
    return (hit[0], hit[-1]) if hit else (None, None)


def containing(text, s, e):
    every = toks(text)
    ts = next((k for k, (a, b) in enumerate(every) if a <= s < b), next((k for k, (a, _) in enumerate(every) if a >= s), None))
    te = next((k for k in reversed(range(len(every))) if every[k][0] < e <= every[k][1]), next((k for k in reversed(range(len(every))) if every[k][1] <= e), None))
    return (ts, te) if ts is not None and te is not None and ts <= te else (None, None)


@pytest.mark.parametrize("specials", [False, True])
@pytest.mark.parametrize("how", [overlapping, containing])
def test_aligned(spark, how, specials):
    rows = made()
    df = spark.createDataFrame(rows, ROW).repartition(3)
    got = {r.doc_id: list(zip(r.t.ts, r.t.te, strict=True)) for r in df.select("doc_id", tokens.aligned(F.col("text"), F.col("spans.start"), F.col("spans.end"), how is containing, specials).alias("t")).collect()}
    for i, text, spans in rows:
        want = [(None, None) if s is None or e is None else how(text, s, e) for s, e in spans or []]
        assert got[i] == [(a if a is None else a + specials, b if b is None else b + specials) for a, b in want]


@pytest.mark.parametrize(("specials", "guarded"), [(False, True), (True, True), (True, False)])
def test_positions(spark, specials, guarded):
    rows = [(i, text, [(a, b) for a in range(-2, 6) for b in range(-2, 6)]) for i, text, _ in made(60, 2)]
    df = spark.createDataFrame(rows, ROW)
    got = {r.doc_id: list(zip(r.p.start, r.p.end, strict=True)) for r in df.select("doc_id", tokens.positions(F.col("text"), F.col("spans.start"), F.col("spans.end"), specials, guarded).alias("p")).collect()}
    for i, text, spans in rows:
        every = [(0, 0), *toks(text), (0, 0)] if specials else toks(text)
        want = []
        for a, b in spans:
            good = 0 <= a <= b < len(every) and (not guarded or (every[a] != (0, 0) and every[b] != (0, 0)))
            want.append((every[a][0], every[b][1]) if good else (None, None))
        assert got[i] == want


@pytest.mark.parametrize("specials", [False, True])
def test_tags_and_runs(spark, specials):
    rows = made(200, 3)
    df = spark.createDataFrame(rows, ROW).select("doc_id", tokens.bio(F.col("text"), F.col("spans.start"), F.col("spans.end"), specials).alias("tags"))
    for r in df.select("doc_id", "tags", tokens.runs(F.col("tags")).alias("r")).collect():
        _, text, spans = rows[r.doc_id]
        want = [0] * len(toks(text))
        for s, e in sorted((s, e) for s, e in spans or [] if s is not None):
            a, b = overlapping(text, s, e)
            if a is not None:
                want[a : b + 1] = [1] + [2] * (b - a)
        assert r.tags == ([-100, *want, -100] if specials else want)
        found, now = [], None
        for k, t in enumerate(want):
            if t == 1 or t == 0:
                now = None
            if t == 1:
                now = [k + specials, k + specials]
                found.append(now)
            elif t == 2 and now:
                now[1] = k + specials
        assert list(zip(r.r.ts, r.r.te, strict=True)) == [tuple(f) for f in found]


def test_offsets_with_specials(spark):
    got = spark.createDataFrame([(1, "a b"), (2, None)], "i long, text string").select("i", tokens.offsets(F.col("text"), specials=True).alias("o"), tokens.counted(F.col("text")).alias("n")).orderBy("i").collect()
    assert [(r.o.s, r.o.e, r.n) for r in got] == [([0, 0, 2, 0], [0, 1, 3, 0], 2), ([0, 0], [0, 0], 0)]


def test_placed_rows(spark):
    docs = spark.createDataFrame([(1, "ab cd", "x"), (2, "", "y"), (3, "z", "z")], "doc_id long, text string, spans string")
    spans = spark.createDataFrame([(1, 0, 5, "A"), (1, 2, 3, "B"), (2, 0, 1, "C"), (9, 0, 1, "D")], "doc_id long, start long, end long, label string")
    got = {(r.doc_id, r.label, r.ts, r.te) for r in tokens.placed(spans, docs, "doc_id", "text").collect()}
    assert got == {(1, "A", 0, 1), (1, "B", None, None), (2, "C", None, None)}


def test_many_spans_on_one_text(spark):
    """100,000 spans of one text, long ones that overlap among them."""
    text = "word " * 100_000
    spans = [(5 * k, 5 * k + (4 if k % 3 else 5000)) for k in range(100_000)]
    df = spark.createDataFrame([(1, text, spans)], ROW)
    begun = time.monotonic()
    row = df.select(tokens.aligned(F.col("text"), F.col("spans.start"), F.col("spans.end")).alias("t"), tokens.bio(F.col("text"), F.col("spans.start"), F.col("spans.end")).alias("tags")).first()
    assert row.t.ts == list(range(100_000)) and row.tags == [1] * 100_000
    assert time.monotonic() - begun < 60


def test_control_characters_in_texts(spark):
    """What marks matches inside may stand in a text."""
    rows = [(1, "\x01a b@c.de \x02 x@y.zz"), (2, "\x02\x01"), (3, "q\x01w@e.rt\x02")]
    got = {(r.doc_id, r.start, r.end, r.value) for r in detect.pattern_spans(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    assert got == {(1, 3, 9, "b@c.de"), (1, 12, 18, "x@y.zz"), (3, 2, 8, "w@e.rt")}


def test_many_matches_in_one_text(spark):
    text = " ".join(f"u{k}@h.io" for k in range(20_000))
    rows = detect.listed(spark.createDataFrame([(1, text)], "doc_id long, text string"), ["doc_id"], "text", {"EMAIL": detect.vocab.PATTERNS["EMAIL"]})
    spans = rows.first().spans
    assert len(spans) == 20_000 and all(text[s.start : s.end] == f"u{k}@h.io" for k, s in enumerate(spans))


def test_python_holds_few_texts_at_once():
    """A batch's texts become Python's a group at a time, whatever the batch's size."""
    column, known = pa.array(["word " * 400, None] * 10_000), np.ones(sys.maxunicode + 1, np.uint8)
    tracemalloc.start()
    total = sum(len(t.count) for _, _, t in tokens._groups(column, known))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == len(column) and peak < 16 << 20
