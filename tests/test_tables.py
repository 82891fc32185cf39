"""SQL table functions, and the data source, on small rows."""

import json
import random

import pytest
from pyspark.sql import functions as F

from spanloom.functions import tables
from spanloom.operators import detect
from spanloom.sources import spans_source


@pytest.fixture
def texts(spark):
    rows = [(1, "mail a@b.cc or 10.0.0.1, \x01 +49 170 1234567"), (2, ""), (3, None), (4, "One. Two! Three? " * 9), (5, "x [[REAL_PII:ORG|Acme\nInc]] y [[b]]")]
    df = spark.createDataFrame(rows, "doc_id long, t string")
    df.createOrReplaceTempView("texts_of_tables")
    tables.register(spark)
    return df


def test_lateral_spans(spark, texts):
    got = {tuple(r) for r in spark.sql("SELECT d.doc_id, s.label, s.start, s.end, s.value FROM texts_of_tables d, LATERAL regex_spans(d.t) s").collect()}
    want = {(r.doc_id, r.label, r.start, r.end, r.value) for r in detect.pattern_spans(texts, "doc_id", "t").collect()}
    assert got == want and len(got) >= 3
    plan = spark.sql("SELECT d.doc_id, s.label FROM texts_of_tables d, LATERAL regex_spans(d.t) s")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Python" not in plan


def test_lateral_chunks_marks_windows_candidates(spark, texts):
    got = [tuple(r) for r in spark.sql("SELECT d.doc_id, s.ord, s.content FROM texts_of_tables d, LATERAL sentence_chunks(d.t, 5) s WHERE d.doc_id = 4 ORDER BY s.ord").collect()]
    want = texts.filter("doc_id = 4").select(detect.sentence_chunks(F.col("t"), 5).alias("c")).first().c
    assert [c for *_, c in got] == want and [k for _, k, _ in got] == list(range(len(want)))
    assert [tuple(r) for r in spark.sql("SELECT s.ord, s.content FROM texts_of_tables d, LATERAL annotation_marks(d.t) s ORDER BY 1").collect()] == [(0, "REAL_PII:ORG|Acme\nInc"), (1, "b")]
    assert [tuple(r) for r in spark.sql("SELECT * FROM token_windows(10L, 4L, 1L)").collect()] == [(0, 0, 3), (1, 3, 6), (2, 6, 9)]
    assert spark.sql("SELECT * FROM token_windows(0L, 4L, 1L)").count() == spark.sql("SELECT * FROM candidate_spans(0L, 4L)").count() == 0
    assert {tuple(r) for r in spark.sql("SELECT * FROM candidate_spans(3L, 2L)").collect()} == {(0, 0), (0, 1), (1, 1), (1, 2), (2, 2)}


LINES = [
    ('{"doc_id": 1, "text": "Ann met Bob", "spans": [{"start": 0, "end": 3, "label": "PERSON", "value": "Ann"}, {"start_position": 8, "end_position": 11, "entity_type": "PERSON", "start": true}]}', 2, []),
    ('{"doc_id": "2", "full_text": "x", "spans": "no"}', None, [("spans", None, "spans is not a list")]),
    ('{"doc_id": 3, "text": 5, "spans": [{"start": 0, "end": 1, "label": "ORG"}]}', 0, [("text", None, "row text is not a string")]),
    ('{"doc_id": 4, "text": "abc", "items": [7, {"start": 1.0, "end": 2, "label": "A"}, {"start": 0, "end": 9, "label": "A"}, {"start": 2, "end": 2, "label": "A"}, {"start": 0, "end": 1}, {"start": 0, "end": 1, "label": " "}, {"start": 0, "end": 1, "label": 4}]}', None, [("items", 0, "span is not an object"), ("items", 1, "start/end are not ints"), ("items", 2, "invalid bounds"), ("items", 3, "invalid bounds"), ("items", 4, "label is not a string"), ("items", 5, "label is empty"), ("items", 6, "label is not a string")]),
    ("{broken", None, [(None, None, "not JSON")]),
    ("[1]", None, [(None, None, "row is not an object")]),
]


def test_rows_and_errors(spark, tmp_path):
    spans_source.register(spark)
    (tmp_path / "a.jsonl").write_text("\n\n".join(line for line, *_ in LINES) + "\n")
    rows = sorted(spark.read.format("spans").load(str(tmp_path)).collect(), key=lambda r: r.offset)
    assert [(None if r.spans is None else len(r.spans), [tuple(e) for e in r.errors]) for r in rows] == [(n, e) for _, n, e in LINES]
    assert rows[0].spans[1].start == 8 and rows[0].doc_id == "1" and rows[1].text == "x" and rows[3]["items"] == []
    with pytest.raises(Exception, match="FileNotFoundError"):
        spark.read.format("spans").load(str(tmp_path / "none")).collect()


@pytest.mark.parametrize("range_bytes", [1, 7, 100, 10**6])
def test_ranges_own_the_lines_that_begin_in_them(spark, tmp_path, range_bytes):
    rng = random.Random(range_bytes)
    spans_source.register(spark)
    few = 12 if range_bytes < 50 else 300
    for k in range(2):
        lines = [json.dumps({"doc_id": f"{k}-{i}", "text": "é" * rng.randrange(30 if range_bytes > 50 else 3)}, ensure_ascii=False) for i in range(few)]
        (tmp_path / f"f{k}.jsonl").write_text("\n".join(lines) + ("\n" if k else ""))
    df = spark.read.format("spans").option("range_bytes", range_bytes).load(str(tmp_path))
    rows = df.select("doc_id", "errors").collect()
    assert sorted(r.doc_id for r in rows) == sorted(f"{k}-{i}" for k in range(2) for i in range(few)) and not any(r.errors for r in rows)
    assert df.rdd.getNumPartitions() == sum(-(-(tmp_path / f"f{k}.jsonl").stat().st_size // range_bytes) for k in range(2))


def test_write_and_stream(spark, tmp_path):
    spans_source.register(spark)
    span = "array<struct<start:bigint,end:bigint,label:string,value:string,category:string,sensitivity:string,note:string>>"
    rows = spark.range(40).select(F.col("id").cast("string").alias("doc_id"), F.lit("text \U0001f600").alias("text"), F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(4).cast("long").alias("end"), F.lit("ORG").alias("label"), *(F.lit(None).cast("string").alias(c) for c in ("value", "category", "sensitivity", "note")))).cast(span).alias("spans"), F.lit(None).cast(span).alias("items"), F.lit(None).cast(span).alias("sensitivity_spans"), F.array().cast("array<struct<field:string,at:int,reason:string>>").alias("errors"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("offset"))
    out = str(tmp_path / "out")
    write = lambda df, mode: df.repartition(3).write.format("spans").mode(mode).save(out)
    write(rows, "append")
    write(rows.filter("doc_id < '2'"), "append")
    back = spark.read.format("spans").load(out)
    assert back.count() == 40 + rows.filter("doc_id < '2'").count() and back.filter("size(errors) > 0 or spans[0].label <> 'ORG' or items is not null").count() == 0
    write(rows.limit(5), "overwrite")
    assert spark.read.format("spans").load(out).count() == 5

    def streamed():
        query = spark.readStream.format("spans").load(out).select("doc_id", "text").writeStream.format("json").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "sink"))
        query.awaitTermination()
        return spark.read.schema("doc_id string").json(str(tmp_path / "sink")).count()

    assert streamed() == 5
    write(rows.filter("doc_id = '7'"), "append")
    assert streamed() == 6 and streamed() == 6
