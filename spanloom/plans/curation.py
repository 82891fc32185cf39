"""Annotation and curation queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C
from ..operators import annotate, resolve
from ..streaming import redaction
from . import fixtures as X


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.documents(spark, sf).select("doc_id", "text", redaction.kept(F.col("text")).alias("kept"))
    return docs.select("doc_id", "text", resolve.replaced(F.col("text"), F.col("kept"), annotate.marked).alias("annotated"))


def annotated_parse(spark: SparkSession, sf: str) -> DataFrame:
    """The items that parsing annotated texts gives back."""
    rows = _annotated(spark, sf).select("doc_id", annotate.parsed(F.col("annotated")).alias("p"))
    return rows.select("doc_id", F.explode("p.items").alias("i")).select("doc_id", "i.start", "i.end", "i.category", "i.label", "i.value")


def annotated_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each text comes back from its annotated form."""
    rows = _annotated(spark, sf).select("doc_id", "text", annotate.parsed(F.col("annotated")).alias("p"))
    return rows.select("doc_id", (F.col("text") == F.col("p.text")).alias("same"), F.size("p.items").cast("bigint").alias("n_items"), F.col("p.error").alias("error"))


def _line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as examples: an item for each line, with a category and a label that its digest fixes, some of them wrong."""
    lines = F.split("text", "\n")
    docs = X.documents(spark, sf).select("doc_id", "text", F.posexplode(lines).alias("k", "line"))
    before = Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    docs = docs.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("bigint"))
    key = F.concat(F.lit("item:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("k").cast("string"))
    u, v = C.uniform(key), C.uniform(F.concat(key, F.lit(":label")))
    category = F.when(u < 0.45, "NON_PII").when(u < 0.65, "PII_LOOKALIKE").when(u < 0.95, "REAL_PII").when(u < 0.995, "PERSON").otherwise("BOGUS")
    label = F.when(v < 0.005, "NOPE").otherwise(F.element_at(F.array(*map(F.lit, vocab.LABELS)), (F.floor(v * 13) + 1).cast("int")))
    item = F.struct("start", (F.col("start") + F.length("line")).alias("end"), category.alias("category"), F.when(category != "NON_PII", label).alias("label"))
    items = docs.select("doc_id", "k", item.alias("item")).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "item"))), lambda s: s["item"]).alias("items"))
    return X.documents(spark, sf).select("doc_id", "text").join(items, "doc_id")


def validate_examples(spark: SparkSession, sf: str) -> DataFrame:
    return annotate.validated(_line_items(spark, sf), "doc_id")


def rejection_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many examples each reason rejects, with its rank within the status."""
    counts = validate_examples(spark, sf).filter("status <> 'OK'").groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    w = Window.partitionBy("status").orderBy(F.desc("n"), "first_doc")
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint"))


def _damaged(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans, some of them spoilt as their digest says."""
    rows = X.gold(spark, sf, with_text=True).withColumn("u", C.uniform(X._key("bad")))
    u = F.col("u")
    return rows.select(
        "doc_id",
        F.col("start").alias("ord"),
        F.col("label").alias("gold_label"),
        F.when(u >= 0.97, None).otherwise(F.col("text")).alias("text"),
        F.when(u < 0.1, None).when(u < 0.2, -1).otherwise(F.col("start")).cast("bigint").alias("start"),
        F.when((u >= 0.2) & (u < 0.3), F.col("start")).when((u >= 0.3) & (u < 0.4), F.length("text") + 1).otherwise(F.col("end")).cast("bigint").alias("end"),
        F.when((u >= 0.4) & (u < 0.5), None).when((u >= 0.5) & (u < 0.6), " \t ").otherwise(F.col("label")).alias("label"),
    )


def malformed_spans(spark: SparkSession, sf: str) -> DataFrame:
    return _damaged(spark, sf).select("doc_id", "ord", "gold_label", annotate.malformed(F.col("text"), F.col("start"), F.col("end"), F.col("label")).alias("reason"))


def enrich_values(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions' values anew from their offsets; mismatch: another value was there before."""
    rows = X.pred(spark, sf, with_text=True)
    old = F.when(C.uniform(X._key("value")) < 0.3, F.upper("value")).otherwise(F.col("value"))
    new = C.slice_text(F.col("text"), F.col("start"), F.col("end"))
    return rows.select("doc_id", "label", "start", "end", "score", new.alias("value"), (old != new).alias("mismatch"))


def _names(spark: SparkSession, sf: str) -> DataFrame:
    """A label in many spellings for each event."""
    raw = [" email ", "Phone_Number", "telephone", "ORGANIZATION", "ip", "zip_code", "First_Name", "person", "gadget", "", "  ", "credit_card", "\tIBAN\n"]
    pick = F.element_at(F.array(*map(F.lit, raw)), (F.col("event_id") % len(raw) + 1).cast("int"))
    return X.table(spark, sf, "events").select("event_id", F.concat(pick, F.when(F.col("event_type") == "click", " ").otherwise("")).alias("raw"))


def label_normalise(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.col("raw")
    return _names(spark, sf).groupBy("raw").agg(F.count(F.lit(1)).alias("n")).select(C.label(raw).alias("label"), C.label_kept(raw).alias("kept"), C.safe_label(raw).alias("safe"), C.slug(raw).alias("slug"), "n", F.length("raw").cast("bigint").alias("size"))


def normalise_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans under one of two namings, in the one form again."""
    rows = X.gold(spark, sf, with_text=True).withColumn("u", C.uniform(X._key("form")))
    old: Column = F.col("u") < 0.5
    none, text = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    span = F.struct(
        F.when(old, F.col("start")).otherwise(none).alias("start"),
        F.when(old, F.col("end")).otherwise(none).alias("end"),
        F.when(~old, F.col("start")).otherwise(none).alias("start_position"),
        F.when(~old & (F.col("u") < 0.95), F.col("end")).otherwise(none).alias("end_position"),
        F.when(old, F.lower("label")).otherwise(text).alias("label"),
        F.when(~old, F.concat(F.lit(" "), F.col("label"))).otherwise(text).alias("entity_type"),
        F.when(F.col("u") < 0.25, F.col("value")).otherwise(text).alias("value"),
        text.alias("entity_value"),
        F.lit("REAL_PII").alias("category"),
        F.when(F.col("u") < 0.1, "redact ").when(F.col("u") < 0.2, "maybe").otherwise(text).alias("sensitivity"),
    )
    out = rows.select("doc_id", annotate.normalised(span, F.col("text")).alias("s")).filter("s is not null")
    return out.select("doc_id", "s.start", "s.end", "s.label", "s.value", "s.sensitivity", C.sensitivity(F.col("s.category")).alias("by_category"))


def dedup_text(spark: SparkSession, sf: str) -> DataFrame:
    """For each different text the first document and how many there are: only digests are shuffled."""
    docs = X.documents(spark, sf).select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"))


def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations in one line, cut, and safe in Markdown."""
    text = F.col("text")
    return X.table(spark, sf, "conversations").select("conv_id", "turn", C.compact(text, 60).alias("short"), F.md5(F.lower(C.collapse(text))).alias("normal_md5"), F.replace(text, F.lit("```"), F.lit("'''")).alias("markdown"), F.replace(text, F.lit("\n"), F.lit("\\n")).alias("one_line"))


def review_lines(spark: SparkSession, sf: str) -> DataFrame:
    """For each document with predictions its lines for review, each value once, in order."""
    w = Window.partitionBy("doc_id", "line").orderBy("start", "end", "label")
    rows = X.pred(spark, sf).withColumn("line", F.concat(C.strip(F.replace("value", F.lit("\n"), F.lit("\\n"))), F.lit(": "), F.col("label")))
    rows = rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    listed = F.array_sort(F.collect_list(F.struct("start", "end", "label", "line")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(listed, lambda s: s["line"]), "\n").alias("section"), F.count(F.lit(1)).alias("n_lines"))


QUERIES = {f.__name__: f for f in (annotated_parse, annotated_roundtrip, validate_examples, rejection_counts, malformed_spans, enrich_values, label_normalise, normalise_spans, dedup_text, text_forms, review_lines)}

_U = X.UNIFORM.format
_STRIP = "regexp_replace({}, '^[\\t-\\r\\x1c-\\x1f \\x{{85}}\\p{{Z}}]+|[\\t-\\r\\x1c-\\x1f \\x{{85}}\\p{{Z}}]+$', '', 'g')".format
_NAMES = "[" + ", ".join(f"'{x}'" for x in vocab.LABELS) + "]"
_ITEMS = f"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents),
o AS (SELECT *, CAST(coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, {_U("'item:' || doc_id || ':' || k")} AS u, {_U("'item:' || doc_id || ':' || k || ':label'")} AS v FROM l),
c AS (SELECT *, start + length(line) AS "end", CASE WHEN u < 0.45 THEN 'NON_PII' WHEN u < 0.65 THEN 'PII_LOOKALIKE' WHEN u < 0.95 THEN 'REAL_PII' WHEN u < 0.995 THEN 'PERSON' ELSE 'BOGUS' END AS cat, CASE WHEN v < 0.005 THEN 'NOPE' ELSE {_NAMES}[CAST(floor(v * 13) + 1 AS INT)] END AS lab FROM o),
d AS (SELECT doc_id, text, k, start, "end", CASE WHEN list_contains({_NAMES}, cat) THEN 'REAL_PII' ELSE cat END AS cat, CASE WHEN cat = 'NON_PII' THEN NULL ELSE lab END AS lab, line FROM c),
e AS (SELECT *, last_value(CASE WHEN cat = 'REAL_PII' AND list_contains({_NAMES}, lab) THEN lab END IGNORE NULLS) OVER (PARTITION BY doc_id, start, "end" ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM d),
f AS (SELECT *, CASE WHEN "end" <= start THEN 'invalid bounds' WHEN {_STRIP('line')} = '' THEN 'only whitespace' WHEN cat = 'BOGUS' THEN 'invalid category'
  WHEN cat = 'REAL_PII' AND NOT list_contains({_NAMES}, lab) THEN 'REAL_PII requires valid label' WHEN cat = 'PII_LOOKALIKE' AND NOT list_contains({_NAMES}, lab) THEN 'PII_LOOKALIKE requires valid label'
  WHEN cat = 'REAL_PII' AND prev <> lab THEN 'conflicting REAL_PII labels' END AS fault FROM e),
g AS (SELECT doc_id, any_value(text) AS text, count(*) AS n, arg_min(fault, k) FILTER (fault IS NOT NULL) AS fault, count(*) FILTER (cat = 'NON_PII') AS a, count(*) FILTER (cat = 'PII_LOOKALIKE') AS b, count(*) FILTER (cat = 'REAL_PII') AS c FROM f GROUP BY doc_id),
h AS (SELECT *, CASE WHEN a < 3 THEN 'too few NON_PII' WHEN b < 1 THEN 'too few PII_LOOKALIKE' WHEN c < 2 THEN 'too few REAL_PII' WHEN a / n < 0.2 OR a / n > 0.7 THEN 'NON_PII ratio' WHEN b / n < 0.1 OR b / n > 0.4 THEN 'PII_LOOKALIKE ratio' WHEN c / n < 0.1 OR c / n > 0.5 THEN 'REAL_PII ratio' END AS retry FROM g),
r AS (SELECT doc_id, CASE WHEN {_STRIP('text')} = '' THEN 'FAIL' WHEN n < 10 OR n > 40 THEN 'RETRY' WHEN fault IS NOT NULL THEN 'FAIL' WHEN retry IS NOT NULL THEN 'RETRY' ELSE 'OK' END AS status,
  CASE WHEN {_STRIP('text')} = '' THEN 'missing/empty text' WHEN n < 10 OR n > 40 THEN 'items count' ELSE coalesce(fault, retry) END AS reason FROM h)
"""
_PREDDOC = "WITH" + X.GOLD + X.PRED
_KEYED = "'{}:' || doc_id || ':' || label || ':' || start"
_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in vocab.ALIASES.items()) + "}"
_LABEL = f"coalesce({_MAP}[up], up)"
ORACLES = {
    "annotated_parse": "WITH" + X.GOLD + X.KEPT + " SELECT doc_id, start, \"end\", 'REAL_PII' AS category, label, substr(text, start + 1, \"end\" - start) AS value FROM kept JOIN documents USING (doc_id)",
    "annotated_roundtrip": "WITH" + X.GOLD + X.KEPT + ", n AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id) SELECT doc_id, true AS same, coalesce(n, 0) AS n_items, NULL::VARCHAR AS error FROM documents LEFT JOIN n USING (doc_id)",
    "validate_examples": _ITEMS + "SELECT * FROM r",
    "rejection_counts": _ITEMS + ", s AS (SELECT status, reason, count(*) AS n, min(doc_id) AS first_doc FROM r WHERE status <> 'OK' GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY status ORDER BY n DESC, first_doc) AS rank FROM s",
    "malformed_spans": "WITH" + X.GOLD + f""", d AS (SELECT g.*, {_U(_KEYED.format('bad'))} AS u, length(text) AS n FROM gold g JOIN documents USING (doc_id))
SELECT doc_id, start AS ord, label AS gold_label, CASE WHEN u >= 0.97 THEN 'row text is not a string' WHEN u < 0.1 THEN 'start/end are not ints' WHEN u < 0.4 THEN 'invalid bounds' WHEN u < 0.5 THEN 'label is not a string' WHEN u < 0.6 THEN 'label is empty' END AS reason FROM d""",
    "enrich_values": _PREDDOC + f' SELECT doc_id, label, start, "end", score, value, CASE WHEN {_U(_KEYED.format("value"))} < 0.3 THEN upper(value) <> value ELSE false END AS mismatch FROM pred',
    "label_normalise": f"""
WITH e AS (SELECT [' email ', 'Phone_Number', 'telephone', 'ORGANIZATION', 'ip', 'zip_code', 'First_Name', 'person', 'gadget', '', '  ', 'credit_card', chr(9) || 'IBAN' || chr(10)][CAST(event_id % 13 + 1 AS INT)] || CASE WHEN event_type = 'click' THEN ' ' ELSE '' END AS raw FROM events),
c AS (SELECT raw, count(*) AS n, upper({_STRIP('raw')}) AS up FROM e GROUP BY raw),
t AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(lower({_STRIP('raw')}), '[^a-z0-9._-]+', '-', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g') AS sl FROM c)
SELECT CASE WHEN up = '' THEN NULL WHEN list_contains({_NAMES[:-1]}, 'NONE'], {_LABEL}) THEN {_LABEL} ELSE 'OTHER' END AS label, {_LABEL} AS kept, CASE WHEN up = '' THEN 'UNKNOWN' ELSE up END AS safe, CASE WHEN sl = '' THEN 'model' ELSE sl END AS slug, n, length(raw) AS size FROM t""",
    "normalise_spans": "WITH" + X.GOLD + f""", d AS (SELECT *, {_U(_KEYED.format('form'))} AS u FROM gold)
SELECT doc_id, start, "end", label, value, CASE WHEN u < 0.1 THEN 'REDACT' END AS sensitivity, 'REDACT' AS by_category FROM d WHERE u < 0.95""",
    "dedup_text": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY 1",
    "text_forms": "WITH c AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS v FROM conversations) SELECT conv_id, turn, CASE WHEN length(v) > 60 THEN rtrim(substr(v, 1, 57)) || '...' ELSE v END AS short, md5(lower(v)) AS normal_md5, replace(text, '```', '''''''') AS markdown, replace(text, chr(10), '\\n') AS one_line FROM c",
    "review_lines": _PREDDOC + f""", l AS (SELECT *, {_STRIP("replace(value, chr(10), '\\n')")} || ': ' || label AS line FROM pred), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY start, "end", label) AS rn FROM l)
SELECT doc_id, string_agg(line, chr(10) ORDER BY start, "end", label, line) AS section, count(*) AS n_lines FROM f WHERE rn = 1 GROUP BY doc_id""",
}
