"""Detection, resolution and redaction queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C
from ..operators import detect, resolve, tokens
from ..streaming import redaction
from . import fixtures as X

_quoted = X._quoted


def regex_spans(spark: SparkSession, sf: str) -> DataFrame:
    return X.gold(spark, sf)


def regex_spans_pages(spark: SparkSession, sf: str) -> DataFrame:
    return detect.pattern_spans(X.table(spark, sf, "pages"), "page_id", "html")


def token_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """How many tokens each document has, and sums of where they start and end, in its row."""
    rows = X.documents(spark, sf).select("doc_id", tokens.offsets(F.col("text")).alias("o"))
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, v: a + v)
    mixed = F.transform("o.s", lambda s, i: i.cast("bigint") * s % 1009)
    return rows.filter("size(o.s) > 0").select("doc_id", F.size("o.s").cast("bigint").alias("n_tokens"), total(F.col("o.s")).alias("sum_start"), total(F.col("o.e")).alias("sum_end"), total(mixed).alias("mixed"))


def candidate_counts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_tokens")
    docs = X.documents(spark, sf).select("doc_id", tokens.counted(F.col("text")).alias("n_tokens"))
    return docs.select("doc_id", n, detect.candidate_count(n, 12).alias("n_candidates"))


def token_windows(spark: SparkSession, sf: str) -> DataFrame:
    docs = X.documents(spark, sf).select("doc_id", tokens.counted(F.col("text")).alias("n"))
    return detect.windows(docs, "doc_id", "n", 512)


def char_to_token(spark: SparkSession, sf: str) -> DataFrame:
    return X.on_tokens(spark, sf).select("doc_id", "label", "start", "end", "ts", "te")


def char_to_token_containing(spark: SparkSession, sf: str) -> DataFrame:
    return X.on_tokens(spark, sf, containing=True).select("doc_id", "label", "start", "end", "ts", "te")


def token_to_char(spark: SparkSession, sf: str) -> DataFrame:
    """Gold spans on tokens, and the characters of these tokens."""
    rows = detect.listed(X.documents(spark, sf), ["doc_id", "text"], "text").filter("size(spans) > 0")
    rows = rows.select("doc_id", "text", "spans", tokens.aligned(F.col("text"), F.col("spans.start"), F.col("spans.end")).alias("t"))
    rows = rows.select("doc_id", "spans", "t", tokens.positions(F.col("text"), F.col("t.ts"), F.col("t.te")).alias("p"))
    each = rows.select("doc_id", F.explode(F.arrays_zip(F.col("spans.label").alias("label"), F.col("t.ts").alias("ts"), F.col("t.te").alias("te"), F.col("p.start").alias("cs"), F.col("p.end").alias("ce"))).alias("z"))
    return each.select("doc_id", "z.*")


def non_overlap_typed(spark: SparkSession, sf: str) -> DataFrame:
    return X.kept(spark, sf)


def _ordered_pred(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("start", "end", "label", "score")
    return X.pred(spark, sf).withColumn("ord", F.row_number().over(w).cast("bigint"))


def nms_redactions(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.suppressed(_ordered_pred(spark, sf), "doc_id")


def nms_by_label(spark: SparkSession, sf: str) -> DataFrame:
    return resolve.suppressed_by_label(_ordered_pred(spark, sf), "doc_id")


def decode_redactions(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions over a threshold, trimmed, then suppressed."""
    from pyspark.sql import Window

    rows = X.pred(spark, sf, with_text=True).withColumn("t", C.trimmed_span(F.col("text"), F.col("start"), F.col("end"))).drop("text", "value")
    w = Window.partitionBy("doc_id").orderBy("start", "end", "label", "score")
    rows = rows.withColumn("ord", F.row_number().over(w).cast("bigint")).filter("score >= 0.25 and not isnan(score) and t is not null")
    return resolve.suppressed(rows.select("doc_id", "label", "t.start", "t.end", "score", "ord"), "doc_id")


def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    """Redacted texts: found, resolved and replaced within each row."""
    docs = X.documents(spark, sf).select("doc_id", "lang", "text", redaction.kept(F.col("text")).alias("kept"))
    docs = docs.select("doc_id", "lang", F.size("kept").cast("bigint").alias("n_spans"), resolve.replaced(F.col("text"), F.col("kept"), redaction.marker).alias("redacted"))
    return docs.select("doc_id", "lang", "n_spans", F.md5("redacted").alias("redacted_md5"), F.length("redacted").cast("bigint").alias("n_chars"))


def redaction_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: spans found, resolved and redacted, counted by language and label."""
    kept = X.kept(spark, sf).join(X.documents(spark, sf).select("doc_id", "lang"), "doc_id")
    return kept.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"), F.sum(F.col("end") - F.col("start")).alias("n_chars"))


def quality_by_redaction(spark: SparkSession, sf: str) -> DataFrame:
    per = X.kept(spark, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    rows = X.table(spark, sf, "labels").join(per, "doc_id", "left")
    return rows.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n_docs"), F.count("n").alias("n_redacted"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_spans"))


def sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(detect.sentence_chunks(F.col("text"), 40)).alias("idx", "chunk"))
    return rows.select("conv_id", "turn", F.col("idx").cast("bigint").alias("idx"), "chunk")


_ORD = """,
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label, score) AS ord FROM pred)"""


def _fold(source: str, order: str, clash: str, extra: str = "") -> str:
    return f"""
SELECT doc_id, k.label AS label, k.start AS start, k."end" AS "end", k.score AS score FROM (SELECT doc_id, unnest(list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {clash})) > 0 THEN acc ELSE list_append(acc, x) END, [l[1]])) AS k
  FROM (SELECT doc_id, list(struct_pack(label := label, start := start, "end" := "end", score := score{extra}) ORDER BY {order}) AS l FROM {source} GROUP BY doc_id))"""


_OVERLAP = 'greatest(k.start, x.start) < least(k."end", x."end")'
_RATIO = '(CASE WHEN least(k."end", x."end") - greatest(k.start, x.start) <= 0 THEN 0.0 ELSE (least(k."end", x."end") - greatest(k.start, x.start)) / least(k."end" - k.start, x."end" - x.start) END)'
_BY_LABEL = f"""
own AS (SELECT doc_id, label, min(ord) AS first, list(struct_pack(label := label, start := start, "end" := "end", score := score, ord := ord) ORDER BY -score, ord) AS l FROM ordered GROUP BY doc_id, label),
ownkept AS (SELECT doc_id, first, unnest(list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: {_RATIO} > 0.35)) > 0 THEN acc ELSE list_append(acc, x) END, [l[1]])) AS k FROM own),
flat AS (SELECT doc_id, first, k.label AS label, k.start AS start, k."end" AS "end", k.score AS score, k.ord AS ord FROM ownkept)"""
_SPACE = "[\\t-\\r\\x1c-\\x1f \\x{85}\\p{Z}]"
_TRIMMED = f""",
cutoff AS (SELECT o.*, d.text, substr(d.text, o.start + 1, o."end" - o.start) AS v FROM ordered o JOIN documents d USING (doc_id) WHERE score >= 0.25),
trimmed AS (SELECT doc_id, label, ord, score, start + length(v) - length(regexp_replace(v, '^{_SPACE}+', '')) AS start,
  start + length(v) - length(regexp_replace(v, '^{_SPACE}+', '')) + length(regexp_replace(v, '^{_SPACE}+|{_SPACE}+$', '', 'g')) AS "end"
  FROM cutoff WHERE regexp_replace(v, '^{_SPACE}+|{_SPACE}+$', '', 'g') <> '')"""
_TOKS_OF_GOLD = "WITH" + X.GOLD + "," + X.TOKEN_PARTS.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT doc_id FROM gold))")

QUERIES = {
    f.__name__: f
    for f in (regex_spans, regex_spans_pages, token_offsets, candidate_counts, token_windows, char_to_token, char_to_token_containing, token_to_char, non_overlap_typed, nms_redactions, nms_by_label, decode_redactions, redact_text, redaction_counts, quality_by_redaction, sentence_chunks)
}

ORACLES = {
    "regex_spans": "WITH" + X.GOLD + " SELECT * FROM gold",
    "regex_spans_pages": "WITH" + X.hits_sql("pages", "page_id", "html") + ' SELECT page_id, label, start, "end", substr(text, start + 1, "end" - start) AS value FROM hit',
    "token_offsets": "WITH" + X.TOKEN_PARTS + " SELECT doc_id, count(*) AS n_tokens, CAST(sum(s) AS BIGINT) AS sum_start, CAST(sum(e) AS BIGINT) AS sum_end, CAST(sum(tok * s % 1009) AS BIGINT) AS mixed FROM toks GROUP BY doc_id",
    "candidate_counts": f"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, {_quoted(vocab.TOKEN)})) AS n FROM documents) SELECT doc_id, n AS n_tokens, least(n, 12) * n - least(n, 12) * (least(n, 12) - 1) // 2 AS n_candidates FROM c",
    "token_windows": f"WITH c AS (SELECT doc_id, len(regexp_extract_all(text, {_quoted(vocab.TOKEN)})) AS n FROM documents), w AS (SELECT doc_id, n, unnest(range(0, greatest(0, CAST(ceil((n - 512) / 448.0) AS BIGINT)) + 1)) AS k FROM c WHERE n > 0) SELECT doc_id, k AS \"window\", k * 448 AS ts, least(k * 448 + 512, n) - 1 AS te FROM w",
    "char_to_token": _TOKS_OF_GOLD + ' SELECT g.doc_id, g.label, g.start, g."end", min(tok) AS ts, max(tok) AS te FROM gold g LEFT JOIN toks t ON g.doc_id = t.doc_id AND greatest(g.start, s) < least(g."end", e) GROUP BY ALL',
    "char_to_token_containing": _TOKS_OF_GOLD
    + ', f AS (SELECT g.doc_id, g.label, g.start, g."end", coalesce(min(tok) FILTER (s <= start AND start < e), min(tok) FILTER (s >= start)) AS ts, coalesce(max(tok) FILTER (s < "end" AND "end" <= e), max(tok) FILTER (e <= "end")) AS te FROM gold g LEFT JOIN toks t ON g.doc_id = t.doc_id GROUP BY ALL) SELECT doc_id, label, start, "end", CASE WHEN ts <= te THEN ts END AS ts, CASE WHEN ts <= te THEN te END AS te FROM f',
    "token_to_char": _TOKS_OF_GOLD
    + ', f AS (SELECT g.doc_id, g.label, g.start, g."end", min(tok) AS ts, max(tok) AS te FROM gold g LEFT JOIN toks t ON g.doc_id = t.doc_id AND greatest(g.start, s) < least(g."end", e) GROUP BY ALL) SELECT f.doc_id, f.label, f.ts, f.te, a.s AS cs, b.e AS ce FROM f LEFT JOIN toks a ON f.doc_id = a.doc_id AND f.ts = a.tok LEFT JOIN toks b ON f.doc_id = b.doc_id AND f.te = b.tok',
    "non_overlap_typed": "WITH" + X.GOLD + X.KEPT + " SELECT * FROM kept",
    "nms_redactions": "WITH" + X.GOLD + X.PRED + _ORD + _fold("ordered", "-score, ord", _OVERLAP),
    "nms_by_label": "WITH" + X.GOLD + X.PRED + _ORD + "," + _BY_LABEL + _fold("flat", "-score, first, ord", f"{_RATIO} > 0.70"),
    "decode_redactions": "WITH" + X.GOLD + X.PRED + _ORD + _TRIMMED + _fold("trimmed", "-score, ord", _OVERLAP),
    "redact_text": "WITH"
    + X.GOLD
    + X.KEPT
    + """,
inorder AS (SELECT doc_id, list(struct_pack(s := start, e := "end", l := label) ORDER BY start DESC) AS l, count(*) AS n FROM kept GROUP BY doc_id),
texts AS (SELECT d.doc_id, d.lang, coalesce(i.n, 0) AS n_spans, CASE WHEN i.n IS NULL THEN d.text ELSE list_reduce(list_prepend(struct_pack(s := 0::BIGINT, e := 0::BIGINT, l := d.text), i.l), lambda acc, x: struct_pack(s := 0::BIGINT, e := 0::BIGINT, l := substr(acc.l, 1, x.s) || '[REDACTED:' || x.l || ']' || substr(acc.l, x.e + 1))).l END AS r
  FROM documents d LEFT JOIN inorder i USING (doc_id))
SELECT doc_id, lang, n_spans, md5(r) AS redacted_md5, length(r) AS n_chars FROM texts""",
    "redaction_counts": "WITH" + X.GOLD + X.KEPT + ' SELECT lang, label, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs, CAST(sum("end" - start) AS BIGINT) AS n_chars FROM kept JOIN documents USING (doc_id) GROUP BY lang, label',
    "quality_by_redaction": "WITH" + X.GOLD + X.KEPT + ", per AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id) SELECT quality, toxic, count(*) AS n_docs, count(n) AS n_redacted, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_spans FROM labels LEFT JOIN per USING (doc_id) GROUP BY quality, toxic",
    "sentence_chunks": """
WITH s AS (SELECT conv_id, turn, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM conversations),
f AS (SELECT conv_id, turn, list_reduce(list_prepend(struct_pack(now := '', done := []::VARCHAR[]), list_transform(l, lambda x: struct_pack(now := x, done := []::VARCHAR[]))),
  lambda a, x: CASE WHEN length(a.now) + length(x.now) < 160 THEN struct_pack(now := CASE WHEN a.now = '' THEN x.now ELSE a.now || ' ' || x.now END, done := a.done)
    ELSE struct_pack(now := x.now, done := CASE WHEN a.now = '' THEN a.done ELSE list_append(a.done, a.now) END) END) AS r FROM s),
c AS (SELECT conv_id, turn, CASE WHEN r.now = '' THEN r.done ELSE list_append(r.done, r.now) END AS chunks FROM f)
SELECT conv_id, turn, unnest(range(0, len(chunks))) AS idx, unnest(chunks) AS chunk FROM c""",
}
