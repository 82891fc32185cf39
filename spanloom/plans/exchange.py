"""Queries through files, streaming forms and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import columns as C
from ..functions import tables
from ..sources import positions, records, seen, spans_source
from ..streaming import redaction
from . import fixtures as X
from . import scoring, spans


def redact_inline(spark: SparkSession, sf: str) -> DataFrame:
    """Redaction as one expression, as streams use it."""
    out = redaction.redacted(F.col("text"))
    return X.documents(spark, sf).select("doc_id", F.md5(out).alias("redacted_md5"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = redaction.counted(X.table(spark, sf, "events"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def numbered_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Positions of documents in doc_id order, for joins by row."""
    return positions.numbered(X.documents(spark, sf).select("doc_id", "text"), ["doc_id"]).select("doc_id", F.col("_row").alias("row"), F.length("text").cast("bigint").alias("n_chars"))


def _in_files(rows: DataFrame, files: int) -> str:
    """rows as JSON lines in so many files, in the order of digests, which is none of their own."""
    path, order = shared.new_path(rows.sparkSession, "lines"), [F.md5(F.col("doc_id").cast("string")), F.col("doc_id")]
    records.write_lines(rows.repartitionByRange(files, *order).sortWithinPartitions(*order), path, "overwrite")
    return path


def paired_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and what a model said of them, written to ten and to seven files in one order, paired by their places there."""
    docs = X.documents(spark, sf)
    gold = positions.read_numbered(spark, _in_files(docs.select("doc_id", "text"), 10), "doc_id long, text string")
    said = docs.select("doc_id", F.md5("text").alias("md5"), F.col("lang").alias("label"))
    pred = positions.read_numbered(spark, _in_files(said, 7), "doc_id long, md5 string, label string")
    rows = positions.paired(pred, gold)
    return rows.select(F.col("_row").alias("row"), F.col("gold.doc_id").alias("doc_id"), F.col("pred.doc_id").alias("pred_id"), F.md5("gold.text").alias("text_md5"), F.col("pred.md5").alias("pred_md5"), "pred.label")


def companion_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Sensitivity of spans from a second file, whose rows stand where their documents stand in the first."""
    one = F.struct(F.lit(0).cast("long").alias("start"), F.length("text").cast("long").alias("end"), F.when(F.col("doc_id") % 3 == 0, "KEEP").otherwise("REDACT").alias("sensitivity"))
    docs = X.documents(spark, sf)
    main = positions.read_numbered(spark, _in_files(docs.select("doc_id", "text"), 6), "doc_id long, text string")
    side = positions.read_numbered(spark, _in_files(docs.select("doc_id", F.array(one).alias("sensitivity_spans")), 9), "sensitivity_spans array<struct<start:bigint,end:bigint,sensitivity:string>>")
    rows = positions.with_companion(main, side).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.explode("sensitivity_spans").alias("s"))
    return rows.select("doc_id", "n_chars", "s.start", "s.end", "s.sensitivity")


def concatenated_json(spark: SparkSession, sf: str) -> DataFrame:
    """Documents printed over several lines one after another, in a file for each part of the table that Spark reads, read back in blocks of the files."""
    path = shared.new_path(spark, "pretty")
    records.write_pretty(X.documents(spark, sf).select("doc_id", F.concat(F.lit('{"'), "text", F.lit('\\"}')).alias("text")), path)
    back = records.read_concatenated(spark, path, "doc_id long, text string")
    return back.select("doc_id", F.md5("text").alias("text_md5"))


#: What is wrong with a document's line, by its doc_id: the spans as JSON, and their error.
_WRONG = ['[{"start": 0, "end": 1, "label": "ORG"}]', '"none"', "[7]", '[{"start": 0.5, "end": 1, "label": "ORG"}]', '[{"start": 1, "end": 1, "label": "ORG"}]', '[{"start": 0, "end": 1, "label": 3}]', '[{"start": 0, "end": 1, "label": "  "}]']


def source_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as lines most of which have something wrong, read back through the data source: what can be used and what is reported."""
    path = shared.new_path(spark, "lines")
    text = F.when(F.col("doc_id") % 11 == 0, F.lit("5")).otherwise(F.to_json(F.struct("text")).substr(F.lit(9), F.length(F.to_json(F.struct("text"))) - 9))
    of = F.element_at(F.array(*map(F.lit, _WRONG)), (F.col("doc_id") % len(_WRONG) + 1).cast("int"))
    line = F.concat(F.lit('{"doc_id": '), F.col("doc_id").cast("string"), F.lit(', "text": '), text, F.lit(', "spans": '), of, F.lit("}"))
    X.documents(spark, sf).select(F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value")).write.text(path)
    rows = spans_source.register(spark).read.format("spans").load(path)
    found = rows.select(F.coalesce("doc_id", F.lit("-")).alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"), F.size(F.coalesce("spans", F.array())).cast("long").alias("n_spans"), F.array_join(F.transform("errors", lambda e: F.concat_ws(":", e["field"], e["at"].cast("string"), e["reason"])), ";").alias("errors"))
    return found.groupBy("doc_id", "text_md5", "n_spans", "errors").agg(F.count(F.lit(1)).alias("n"))


def lateral_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Pattern matches of all documents by a table function of SQL."""
    tables.register(spark)
    X.documents(spark, sf).createOrReplaceTempView("_lateral_documents")
    return spark.sql("SELECT d.doc_id, s.label, s.start, s.end, s.value FROM _lateral_documents d, LATERAL regex_spans(d.text) s")


def resumed_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a second run adds to a history of texts that a first run, of source src0, began, and how many texts that held."""
    docs, path = X.documents(spark, sf).select("doc_id", "text", "source"), shared.new_path(spark, "history")
    before, _ = seen.scan(spark, path)
    seen.remember(seen.resumed(docs.filter("source = 'src0'"), path), path)
    count, _ = seen.scan(spark, path)
    fresh = seen.resumed(docs.filter("source <> 'src0'"), path)
    return fresh.select("doc_id", F.md5("text").alias("text_md5"), F.lit(count - before).cast("long").alias("n_seen"))


def unseen_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of other sources than src0 whose texts src0 doesn't have."""
    docs = X.documents(spark, sf)
    return seen.unseen(docs.filter("source <> 'src0'"), docs.filter("source = 'src0'")).select("doc_id", F.md5("text").alias("text_md5"))


def json_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans as JSON and back."""
    rows = X.gold(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label", "value"))).alias("spans"))
    back = rows.select("doc_id", F.from_json(F.to_json(F.struct("spans")), f"spans array<{records.SPAN}>").alias("r"))
    return back.select("doc_id", F.explode("r.spans").alias("s")).select("doc_id", "s.start", "s.end", "s.label", "s.value")


def metric_report(spark: SparkSession, sf: str) -> DataFrame:
    """Exact and value counts of all documents in one row."""
    exact = scoring.E.counted(scoring.match_exact(spark, sf)).select(*(F.col(c).alias(f"exact_{c}") for c in ("tp", "fp", "fn")))
    value = scoring.E.counted(scoring.match_value(spark, sf)).select(*(F.col(c).alias(f"value_{c}") for c in ("tp", "fp", "fn")))
    both = exact.crossJoin(value)
    _, _, f1 = C.prf(*(F.col(f"value_{c}").cast("double") for c in ("tp", "fp", "fn")))
    return both.withColumn("value_f1", F.round(f1, 6))


QUERIES = {f.__name__: f for f in (redact_inline, event_windows, numbered_documents, paired_rows, companion_rows, concatenated_json, source_errors, lateral_spans, resumed_texts, unseen_texts, json_roundtrip, metric_report)}

ORACLES = {
    "redact_inline": spans.ORACLES["redact_text"].replace("SELECT doc_id, lang, n_spans, md5(r) AS redacted_md5, length(r) AS n_chars FROM texts", "SELECT doc_id, md5(r) AS redacted_md5 FROM texts"),
    "event_windows": "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "numbered_documents": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, length(text) AS n_chars FROM documents",
    "paired_rows": "SELECT row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS row, doc_id, doc_id AS pred_id, md5(text) AS text_md5, md5(text) AS pred_md5, lang AS label FROM documents",
    "companion_rows": "SELECT doc_id, length(text) AS n_chars, 0::BIGINT AS start, length(text) AS \"end\", CASE WHEN doc_id % 3 = 0 THEN 'KEEP' ELSE 'REDACT' END AS sensitivity FROM documents",
    "concatenated_json": """SELECT doc_id, md5('{"' || text || '\\"}') AS text_md5 FROM documents""",
    "source_errors": """WITH e AS (SELECT doc_id, text, doc_id % 11 = 0 AS no_text, doc_id % 7 AS k FROM documents),
q AS (SELECT CASE WHEN doc_id % 13 = 0 THEN '-' ELSE doc_id::VARCHAR END AS doc_id, md5(CASE WHEN doc_id % 13 = 0 OR no_text THEN '' ELSE text END) AS text_md5, CASE WHEN doc_id % 13 = 0 OR no_text OR k <> 0 THEN 0 WHEN text = '' THEN 0 ELSE 1 END AS n_spans,
  CASE WHEN doc_id % 13 = 0 THEN 'not JSON' ELSE coalesce(array_to_string([CASE WHEN no_text THEN 'text:row text is not a string' END, CASE WHEN k = 1 THEN 'spans:spans is not a list' WHEN k = 2 THEN 'spans:0:span is not an object' WHEN k = 3 THEN 'spans:0:start/end are not ints' WHEN no_text THEN NULL WHEN k = 4 OR text = '' THEN 'spans:0:invalid bounds' WHEN k = 5 THEN 'spans:0:label is not a string' WHEN k = 6 THEN 'spans:0:label is empty' END], ';'), '') END AS errors FROM e)
SELECT doc_id, text_md5, n_spans, errors, count(*) AS n FROM q GROUP BY ALL""",
    "lateral_spans": "WITH" + X.GOLD + ' SELECT doc_id, label, start, "end", value FROM gold',
    "resumed_texts": "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5, (SELECT count(DISTINCT text) FROM documents WHERE source = 'src0') AS n_seen FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY text",
    "unseen_texts": "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents WHERE source <> 'src0' AND text NOT IN (SELECT text FROM documents WHERE source = 'src0') GROUP BY text",
    "json_roundtrip": "WITH" + X.GOLD + " SELECT doc_id, start, \"end\", label, value FROM gold",
    "metric_report": scoring._BOTH + scoring._EXACT.replace("p AS", "xp AS").replace("g AS", "xg AS").replace("FROM p)", "FROM xp)").replace("FROM g)", "FROM xg)").replace("m AS (SELECT", "xm AS (SELECT") + scoring._VALUES + scoring._MATCHED
    + ", a AS (SELECT count(*) FILTER (kind = 'tp') AS exact_tp, count(*) FILTER (kind = 'fp') AS exact_fp, count(*) FILTER (kind = 'fn') AS exact_fn FROM xm), b AS (SELECT count(*) FILTER (kind = 'tp') AS value_tp, count(*) FILTER (kind = 'fp') AS value_fp, count(*) FILTER (kind = 'fn') AS value_fn FROM m) SELECT *, round(CASE WHEN value_tp = 0 THEN 0.0::DOUBLE ELSE 2 * value_tp / (2 * value_tp + value_fp + value_fn) END, 6) AS value_f1 FROM a, b",
}
