"""Scorers, SQL functions, reports and the command line."""

import json
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom import __main__ as cli
from spanloom import catalog
from spanloom.functions import columns as C
from spanloom.functions import sql
from spanloom.operators import report, score, vectors

TEXT = "Mail a.b@cd.ef or call +1 (706) 555-3138 now."


def test_infer(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "nothing"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in score.infer(docs, "doc_id", "text").collect()}
    assert got[1].redacted == "Mail [REDACTED:EMAIL] or call [REDACTED:PHONE] now." and [x.label for x in got[1].redactions] == ["EMAIL", "PHONE"]
    assert got[2].redacted == "nothing" and got[2].n_spans == 0
    high = {r.doc_id: r.redacted for r in score.infer(docs, "doc_id", "text", threshold={"PHONE": 0.9, "": 0.5}).collect()}
    assert high[1].endswith("call +1 (706) 555-3138 now.")


def test_own_scorer(spark):
    def first_word(batches):
        for b in batches:
            words = [(t or "").split(" ")[0] for t in b.column("text").to_pylist()]
            n = len(words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(["PERSON"] * n), pa.array([0] * n, pa.int64()), pa.array([len(w) for w in words], pa.int64()), pa.array([0.9] * n)], names=["doc_id", "label", "start", "end", "score"])

    docs = spark.createDataFrame([(1, "Maria calls")], "doc_id long, text string")
    assert score.infer(docs, "doc_id", "text", score.by_batches(first_word)).first().redacted == "[REDACTED:PERSON] calls"


def test_logits_and_windows(spark):
    docs = spark.createDataFrame([(1, "Ann met Bob")], "doc_id long, text string")
    types = lambda k: [5.0 if i == k else 0.0 for i in range(14)]
    rows = [(1, 0, 0, types(1), [3.0, 0.0]), (1, 1, 1, types(0), [3.0, 0.0]), (1, 2, 2, types(1), [0.0, 3.0])]
    cands = spark.createDataFrame(rows, "doc_id long, ts long, te long, types array<double>, redact array<double>")
    got = score.by_logits(cands, "doc_id", "types", "redact", docs).collect()
    assert [(r.label, r.start, r.end) for r in got] == [("PERSON", 0, 3)] and 0.8 < got[0].score < 1
    spans = spark.createDataFrame([(1, 0, 0, 5, "A", 0.5), (1, 1, 0, 5, "A", 0.9), (1, 1, 3, 8, "B", 0.8)], "doc_id long, window long, start long, end long, label string, score double")
    assert [(r.label, r.score) for r in score.merged_windows(spans, "doc_id").collect()] == [("A", 0.9)]


def test_represented(spark):
    docs = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]]), (2, None)], "doc_id long, hidden array<array<double>>")
    spans = spark.createDataFrame([(1, 0, 1), (1, 1, 3), (1, None, 1), (1, 2, 2), (2, 0, 0), (3, 0, 0)], "doc_id long, ts long, te long")
    got = {(r.doc_id, r.ts, r.te): r.vector for r in vectors.represented(docs, spans, "doc_id", [[0.5], [0.25]]).collect()}
    assert got == {(1, 0, 1): [1.0, 2.0, 3.0, 4.0, 2.0, 3.0, 0.25], (1, 1, 3): None, (1, None, 1): None, (1, 2, 2): [9.0, 9.0, 9.0, 9.0, 9.0, 9.0, 0.5], (2, 0, 0): None}


def test_wide_spans_take_no_longer():
    rng = np.random.default_rng(1)
    hidden = rng.standard_normal((20_000, 16))
    ts = rng.integers(0, 10_000, 20_000)
    te = ts + rng.integers(0, 10_000, 20_000)
    begun = time.monotonic()
    made = vectors.of_spans(hidden, ts, te)
    assert time.monotonic() - begun < 2
    for k in range(0, 20_000, 1999):
        assert made[k, 32:] == pytest.approx(hidden[ts[k] : te[k] + 1].mean(0))


@pytest.mark.parametrize("spans", [(5, 8, 5, 8), (10, 12, 11, 13), (0, 3, 5, 9), (0, 10, 2, 4)])
def test_sql_functions(spark, spans):
    sql.register(spark)
    a, b, c, d = spans
    want = spark.range(1).select(C.overlap_credit(*map(F.lit, spans)), C.char_iou(*map(F.lit, spans)), C.chars_overlap(*map(F.lit, spans))).first()
    got = spark.sql(f"SELECT overlap_credit({a}, {b}, {c}, {d}), char_iou({a}, {b}, {c}, {d}), chars_overlap({a}, {b}, {c}, {d}), slice_text('abcdef', -2, 3), f1(1, 1, 0)").first()
    assert tuple(got)[:3] == pytest.approx(tuple(want)) and got[3] == "abc" and got[4] == pytest.approx(2 / 3)


def test_reports(spark, sf):
    taxonomy, confusion = catalog.QUERIES["error_taxonomy"](spark, sf), catalog.QUERIES["confusion_matrix"](spark, sf)
    text, page = report.markdown(taxonomy, confusion), report.html(taxonomy, confusion)
    assert "## False positives" in text and "| label | count |" in text and page.count("<tr>") >= 14
    assert report.table(["a"], []) == "-\n" and "0.5000" in report.console({"f1": 0.5, "n": 3})


def test_commands(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text(json.dumps({"text": TEXT, "spans": [{"start": 5, "end": 14, "label": "email"}, {"start": 9, "end": 3, "label": "ORG"}]}) + "\n")
    cli.main(["redact", str(tmp_path / "in.jsonl"), str(tmp_path / "out")])
    assert "[REDACTED:EMAIL]" in spark.read.json(str(tmp_path / "out")).first().redacted
    cli.main(["curate", str(tmp_path / "in.jsonl"), str(tmp_path / "spans")])
    rows = spark.read.json(str(tmp_path / "spans")).collect()
    assert {getattr(r, "malformed", None) for r in rows} == {None, "invalid bounds"} and {r.span.value for r in rows} >= {"a.b@cd.ef"}
    (tmp_path / "g.jsonl").write_text('{"doc_id": "1", "spans": [{"start": 0, "end": 3, "label": "ORG"}]}\n')
    (tmp_path / "p.jsonl").write_text('{"doc_id": "1", "spans": [{"start": 0, "end": 3, "label": "organization"}]}\n')
    cli.main(["evaluate", str(tmp_path / "p.jsonl"), str(tmp_path / "g.jsonl"), str(tmp_path / "metrics")])
    assert {r.label: r.tp for r in spark.read.json(str(tmp_path / "metrics")).collect()}["ORG"] == 1
