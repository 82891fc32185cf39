"""Single expressions and operators on small rows, and random rows against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import annotate, detect, evaluate, resolve, supervise, tokens
from spanloom.sources import positions, records
from spanloom.streaming import redaction


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*values):
    return [F.lit(v) for v in values]


@pytest.mark.parametrize(("text", "start", "end", "label", "want"), [
    ("Card 4111 1111 1111 1111 on file.", 5, 15, "CREDIT_CARD", True),
    ("Lives at 123 Oak St, Springfield, IL 62704.", 9, 41, "ADDRESS", True),
    ("Contact jane.doe@acme.example for details.", 8, 29, "EMAIL", False),
    ("   ", 0, 3, "PERSON", True),
])
def test_suspicious(spark, text, start, end, label, want):
    assert one(spark, C.suspicious(*lit(text, start, end, label))) is want


def test_geometry(spark):
    assert one(spark, C.overlap_credit(*lit(5, 8, 5, 8))) == 1.0
    assert one(spark, C.overlap_credit(*lit(10, 12, 11, 13))) == 1 / 16
    assert one(spark, C.overlap_credit(*lit(1, 2, 4, 5))) == 0.0
    assert tuple(one(spark, C.trimmed_span(*lit("  Maria Rossi  ", 0, 15)))) == (2, 13)
    assert one(spark, C.trimmed_span(*lit("    ", 0, 4))) is None
    assert one(spark, C.slice_text(*lit("ab\U0001f600cd", -3, 99))) == "ab\U0001f600cd"
    assert one(spark, C.char_iou(*lit(0, 10, 5, 15))) == pytest.approx(5 / 15)


def test_labels(spark):
    for raw, want in ((" email ", "EMAIL"), ("Telephone", "PHONE"), ("gadget", "OTHER"), (" ", None), (None, None)):
        assert one(spark, C.label(F.lit(raw).cast("string"))) == want
    assert one(spark, C.label_kept(F.lit("gadget"))) == "GADGET"
    assert one(spark, C.slug(F.lit(" My  Model/7b! "))) == "my-model-7b"


def spans(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "doc_id long, start long, end long, label string, score double, ord long")


def test_non_overlapping(spark):
    rows = [(10, 30, "ADDRESS", 0.91, 0), (17, 22, "ADDRESS", 0.70, 1), (40, 45, "OTHER", 0.88, 2)]
    assert {(r.start, r.end) for r in resolve.non_overlapping(spans(spark, rows), "doc_id").collect()} == {(10, 30), (40, 45)}
    tie = [(10, 15, "ORG", 0.8, 0), (10, 22, "ORG", 0.8, 1)]
    assert [(r.start, r.end) for r in resolve.non_overlapping(spans(spark, tie), "doc_id").collect()] == [(10, 22)]
    assert [(r.start, r.end) for r in resolve.suppressed(spans(spark, [(10, 30, "A", 0.9, 0), (20, 40, "B", 0.89, 1)]), "doc_id", 0.99).collect()] == [(10, 30)]


def test_credit_random(spark):
    rng = random.Random(5)
    docs = {d: ([(rng.randrange(9), rng.randrange(4)) for _ in range(rng.randrange(6))], [(rng.randrange(9), rng.randrange(4)) for _ in range(rng.randrange(6))]) for d in range(60)}
    side = lambda k, name: spark.createDataFrame([(d, i, s, s + n, "X") for d, both in docs.items() for i, (s, n) in enumerate(both[k])], f"doc_id long, {name} long, ts long, te long, label string")
    got = {r.doc_id: r.credit for r in evaluate.total_credit(evaluate.credit_pairs(side(0, "pi"), side(1, "gi"), "doc_id", True), "doc_id").collect()}
    for d, (p, g) in docs.items():
        pairs = []
        for i, (a, m) in enumerate(p):
            for j, (b, n) in enumerate(g):
                k = min(a + m, b + n) - max(a, b) + 1
                if k > 0:
                    pairs.append((-(1.0 if (a, m) == (b, n) else 2.0 ** -(m + 1 + n + 1 - k)), i, j))
        used_p, used_g, total = set(), set(), 0.0
        for c, i, j in sorted(pairs):
            if i not in used_p and j not in used_g:
                used_p.add(i)
                used_g.add(j)
                total -= c
        assert got.get(d, 0.0) == pytest.approx(total)


def test_markers(spark):
    text = "a [[REAL_PII:EMAIL|x@y.zz]] \U0001f600 [[PII_LOOKALIKE:org|Acme\nInc]] [[NON_PII:|42]] end"
    got = one(spark, annotate.parsed(F.lit(text)))
    assert got.text == "a x@y.zz \U0001f600 Acme\nInc 42 end" and got.error is None
    assert [(i.label, got.text[i.start : i.end]) for i in got["items"]] == [("EMAIL", "x@y.zz"), ("ORG", "Acme\nInc"), (None, "42")]
    for bad, why in (("[[REAL_PII:EMAIL|]]", "empty value"), ("[[x|y]]", "marker without root, label and value"), ("[[FOO:EMAIL|y]]", "unknown root"), ("[[REAL_PII:ZZ|y]]", "unknown label"), ("open [[REAL_PII:EMAIL|y", "unterminated marker")):
        assert one(spark, annotate.parsed(F.lit(bad))).error == why


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "Hi, \U0001f600 b_2!"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.tok, r.s, r.e) for r in tokens.listed(docs, "doc_id", "text").orderBy("tok").collect()] == [(0, 0, 2), (1, 2, 3), (2, 4, 5), (3, 6, 9), (4, 9, 10)]


def test_bio_stray(spark):
    tags = F.array(*(F.lit({"O": 0, "B": 1, "I": 2, "S": -100}[t]) for t in "SIBIOIBBSIS"))
    got = one(spark, tokens.runs(tags))
    assert list(zip(got.ts, got.te, strict=True)) == [(2, 3), (6, 6), (7, 9)]
    assert one(spark, tokens.runs(F.array().cast("array<int>"))).ts == []


def test_group_iou(spark):
    cand = spark.createDataFrame([(1, 1, 5)], "doc_id long, ts long, te long")
    gold = spark.createDataFrame([(1, 2, 3, "ORG"), (1, 4, 6, "ORG")], "doc_id long, ts long, te long, label string")
    assert supervise.group_iou(cand, gold, "doc_id").first().iou == pytest.approx(4 / 6)


def test_schedules(spark):
    assert one(spark, supervise.linear_schedule(0.1, 0.9, F.lit(30), 60)) == pytest.approx(0.5)
    assert one(spark, supervise.linear_schedule(0.1, 0.9, F.lit(99), 60)) == pytest.approx(0.9)
    assert one(spark, supervise.keep_probability(F.lit(0.1), F.lit(0.0))) == 1.0


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "x", "spans": [{"start": 0, "end": 1, "label": "ORG"}]}\n\n{"full_text": "y"}\n')
    (tmp_path / "b.json").write_text('[{"text": "p"},\n {"text": "q"}]')
    (tmp_path / "c.txt").write_text('{\n "text": "one"\n}\n{\n "text": "two"\n}\n')
    a = records.read(spark, str(tmp_path / "a.jsonl"))
    assert sorted(r[0] for r in a.select(records.text_of(a)).collect()) == ["x", "y"]
    assert records.read(spark, str(tmp_path / "b.json")).count() == 2
    assert [r.text for r in records.read_concatenated(spark, str(tmp_path / "c.txt")).orderBy("idx").collect()] == ["one", "two"]
    (tmp_path / "d.jsonl").write_text('{"text": "x"}\nnot json\n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt"):
        records.read_lines(spark, str(tmp_path / "d.jsonl")).collect()
    assert records.read_lines(spark, str(tmp_path / "d.jsonl"), strict=False).filter("_corrupt_record is not null").cache().count() == 1
    records.write_pretty(a.select("text"), str(tmp_path / "e"))
    assert records.read_concatenated(spark, str(tmp_path / "e"), "text string").count() == 2


def test_companion(spark):
    main = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "id long, text string")
    side = spark.createDataFrame([(i, [i]) for i in range(50)], "id long, sensitivity_spans array<long>")
    got = positions.with_companion(main, side, ["id"]).select("id", "sensitivity_spans").collect()
    assert len(got) == 50 and all(r.sensitivity_spans == [r.id] for r in got)
    with pytest.raises(ValueError, match="companions"):
        positions.with_companion(main, side.limit(3), ["id"])


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": 1, "text": "mail a@b.cc now", "ts": "2024-01-01T00:00:00"}\n{"doc_id": 2, "text": "mail a@b.cc now", "ts": "2024-01-01T00:01:00"}\n')
    query = redaction.stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("redacted").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert [r.redacted for r in spark.table("redacted").collect()] == ["mail [REDACTED:EMAIL] now"]
