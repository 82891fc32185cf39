"""Responses and records of training, on small rows."""

import pytest
from pyspark.sql import functions as F

from spanloom.operators import progress, responses


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "want"), [
    ('```json\n{"a": 1}\n```', '{"a": 1}'),
    (' {"a": 1} ', '{"a": 1}'),
    ("```\nx\n```", "x"),
])
def test_bare_json(spark, raw, want):
    assert one(spark, responses.bare_json(F.lit(raw))) == want


@pytest.mark.parametrize(("raw", "want"), [
    ('so: {"a": {"b": 1}} and {"c": 2}', '{"a": {"b": 1}}'),
    ("no braces", "no braces"),
    ("{open {x}", "{open {x}"),
    ("} {y}", "{y}"),
    ("", ""),
])
def test_first_object(spark, raw, want):
    assert one(spark, responses.first_object(F.lit(raw))) == want


def test_examples(spark):
    rows = [
        (1, '{"examples": [{"annotated_text": "a [[REAL_PII:EMAIL|x@y.zz]]"}, {"text": "abc", "items": [{"start": 1, "end": 2, "category": "REAL_PII", "label": "ORG"}]}]}'),
        (2, '{"examples": [{"annotated_text": "fine"}, {"text": "abc"}]}'),
        (3, "not json"),
        (4, None),
    ]
    df = spark.createDataFrame(rows, "call long, content string")
    got = sorted(responses.examples(df, "call", "content").collect(), key=lambda r: (r.call, r.idx or 0))
    assert [(r.call, r.text) for r in got] == [(1, "a x@y.zz"), (1, "abc"), (2, "fine"), (2, "abc"), (3, None), (4, None)]
    assert got[0].error is None and got[1]["items"][0].value == "b"
    assert got[2].error == got[3].error == "neither annotated_text nor text and items" and got[4].error == got[5].error == "no examples"


def test_overlap_weight(spark):
    assert [one(spark, progress.overlap_weight(F.lit(e))) for e in (0, 12, 24, 36, 99)] == pytest.approx([0, 0, 0.1, 0.2, 0.2])
    assert one(spark, progress.overlap_weight(F.lit(20), 12, 12)) == 0.2


def test_stopping(spark):
    losses = [5.0, 4.0, 4.0, 4.0, 3.0]
    df = spark.createDataFrame([(1, i, x, x) for i, x in enumerate(losses)] + [(2, 0, float("nan"), float("nan"))], "run long, epoch long, a double, t double")
    got = {r.run: (r.last_epoch, r.best_epoch) for r in progress.stopped(df, "run", ["a"], "t", patience=2).collect()}
    assert got == {1: (3, 1), 2: (0, 0)}
