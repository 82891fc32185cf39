"""Training rows, gold of both lists, candidates around special tokens, places to redact, event logs."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import columns as C
from spanloom.operators import annotate, supervise, tokens
from spanloom.sources import records

from .test_units import one

SPAN = "struct<start:bigint,end:bigint,start_position:bigint,end_position:bigint,label:string,entity_type:string>"


def test_gold_of_both_lists(spark):
    rows = [([(0, 1, None, None, "name", None), (None, 2, 3, 4, None, "zipcode"), (0, 1, None, None, "NONE", None), (0, None, None, None, "ORG", None)], [(0, 1, None, None, "strange ", None), (5, 6, None, None, None, None)]), (None, None)]
    df = spark.createDataFrame(rows, f"spans array<{SPAN}>, items array<{SPAN}>")
    got = [[tuple(s) for s in r.g] for r in df.select(annotate.gold_rows(F.col("spans"), F.col("items")).alias("g")).collect()]
    assert got == [[(0, 1, "PERSON"), (3, 4, "ADDRESS"), (0, 1, "STRANGE")], []]


@pytest.mark.parametrize("by_rank", [False, True])
def test_candidates_around_special_tokens(spark, by_rank):
    offsets = [(0, 0), (0, 2), (2, 3), (0, 0), (4, 6), (6, 8), (0, 0)]
    df = spark.createDataFrame([([a for a, _ in offsets], [b for _, b in offsets]), ([], [])], "s array<bigint>, e array<bigint>")
    got = [[tuple(c) for c in r.c] for r in df.select(tokens.candidates(F.struct("s", "e"), 3, by_rank).alias("c")).collect()]
    valid = [k for k, o in enumerate(offsets) if o != (0, 0)]
    if by_rank:
        want = [(valid[i], valid[j]) for i in range(len(valid)) for j in range(i, min(i + 3, len(valid)))]
    else:
        want = [(a, b) for a in valid for b in range(a, min(a + 3, len(offsets))) if all(k in valid for k in range(a, b + 1))]
    assert got == [want, []]


def test_places_to_redact(spark):
    items = spark.createDataFrame([(1, 0, 2, "REAL_PII", "x", 0), (1, 0, 2, "real_pii", None, 1), (1, 3, 4, "PII_LOOKALIKE", "y", 0), (1, None, 4, "REAL_PII", "z", 0), (1, 5, 6, None, "q", 0)], "d long, start long, end long, category string, value string, ord int")
    more = spark.createDataFrame([(1, 0, 2, "REDACT", "no", 0), (1, 3, 4, "REDACT", "first", 0), (1, 3, 4, "REDACT", "second", 1), (1, 5, 6, "KEEP", "k", 0)], "d long, start long, end long, sensitivity string, value string, ord int")
    docs = spark.createDataFrame([(1, "abcdef")], "d long, text string")
    assert {tuple(r) for r in supervise.redact_places(items, more, docs, "d", "text").collect()} == {(1, 0, 2, "ab"), (1, 3, 4, "first")}
    spans = spark.createDataFrame([(0, 1, "ORG", None), (0, 1, "NONE", None), (0, 1, "ZZ", None), (None, 1, "ORG", None), (0, 1, "ORG", "NON_PII_NUMBER"), (0, 1, "EMAIL", "REAL_PII")], "start long, end long, label string, category string")
    assert [r.label for r in supervise.typed(spans).collect()] == ["ORG", "EMAIL"]


def test_training_files(spark, tmp_path):
    path = tmp_path / "train.jsonl"
    path.write_text("\n".join(json.dumps(r) for r in [{"text": "Ann", "spans": [{"start": 0, "end": 3, "label": "name"}, {"start": 0, "end": 1}, {"label": "ORG"}]}, {"full_text": "x"}]))
    assert [(r.text, [(s.label, s.value) for s in r.spans]) for r in records.read_training(spark, str(path)).collect()] == [("Ann", [("PERSON", "Ann")]), ("x", [])]
    for bad in ('{"text": "a", "spans": "b"}', '{"spans": []}'):
        path.write_text(bad)
        with pytest.raises(Exception, match="MALFORMED|neither text"):
            records.read_training(spark, str(path)).collect()


def test_event_log_is_appended(spark, tmp_path):
    log = str(tmp_path / "a" / "b" / "log")
    for k in range(3):
        records.write_lines(spark.createDataFrame([("call", k)], "type string, n long"), log)
    assert sorted(r.n for r in spark.read.json(log).collect()) == [0, 1, 2]


def test_safe_value(spark):
    assert one(spark, C.safe_value(F.lit(None).cast("string"))) == "" and one(spark, C.safe_value(F.lit(" x"))) == " x"
