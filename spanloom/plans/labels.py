"""Candidates of whole documents with their targets, and decisions by label."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import labelling, score
from . import fixtures as X
from . import spans as S

#: Least scores by label, and of labels without one.
LEAST, LEAST_OTHER = {"PHONE": 0.3, "EMAIL": 0.1, "OTHER": 0.72}, 0.2


def _supervised(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with its number of tokens, its gold (seven tenths of what patterns find, half of that with a sensitivity) and all places that patterns find."""
    docs, found = X.sized(spark, sf)
    found = found.withColumn("u", C.uniform(X._key("known")))
    order = F.struct("start", "end", "label")
    types = labelling.placed(found.filter("u < 0.7"), "doc_id", "label", order).withColumnRenamed("gold", "types")
    senses = found.filter("u < 0.35").withColumn("sense", F.when(F.col("label") == "PHONE", "KEEP").otherwise("REDACT"))
    senses = labelling.placed(senses, "doc_id", "sense", order).withColumnRenamed("gold", "senses")
    place = F.struct("ts", "te")
    other = found.groupBy("doc_id").agg(F.collect_set(F.when((F.col("label") == "IP_ADDRESS") & (F.col("u") < 0.7), place)).alias("lookalikes"), F.collect_set(place).alias("extra"))
    for side in (types, senses, other):
        docs = docs.join(side, "doc_id", "left")
    kinds = {"types": labelling.PLACED, "senses": labelling.PLACED, "lookalikes": labelling.PLACES, "extra": labelling.PLACES}
    return docs.withColumns({c: F.coalesce(c, F.array().cast(kind)).cast(kind) for c, kind in kinds.items()})


def candidate_labels(spark: SparkSession, sf: str) -> DataFrame:
    """All candidates of at most 12 tokens of all documents, a fifth of the negatives, counted by what they are given."""
    rows = labelling.labelled(_supervised(spark, sf), "doc_id", rate=0.2)
    # nearly all are 0 or 1, and rounding takes its time
    rounded = lambda c: F.when(F.col(c).isin(0.0, 1.0), F.col(c)).otherwise(F.round(c, 6)).alias(c)
    by = ["doc_id", "label", "sensitivity", "best_label", rounded("weight"), rounded("redact")]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts"), F.sum("te").alias("sum_te"))


def decode_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions at or over their label's threshold, suppressed within labels and then across them."""
    return score.decoded_by_label(S._ordered_pred(spark, sf), "doc_id", LEAST, LEAST_OTHER)


QUERIES = {f.__name__: f for f in (candidate_labels, decode_by_label)}

_U = X.UNIFORM.format
_SUPERVISED = S._TOKS_OF_GOLD + f""",
at_ AS (SELECT g.doc_id, g.label, g.start, g."end", min(tok) AS ts, max(tok) AS te, {_U("'known:' || g.doc_id || ':' || g.label || ':' || g.start")} AS u FROM gold g JOIN toks t ON g.doc_id = t.doc_id AND greatest(g.start, s) < least(g."end", e) GROUP BY ALL),
types AS (SELECT doc_id, ts, te, min((start, "end", label)) AS o, arg_max(label, (start, "end", label)) AS label FROM at_ WHERE u < 0.7 GROUP BY doc_id, ts, te),
senses AS (SELECT doc_id, ts, te, min((start, "end", label)) AS o, arg_max(CASE WHEN label = 'PHONE' THEN 'KEEP' ELSE 'REDACT' END, (start, "end", label)) AS label FROM at_ WHERE u < 0.35 GROUP BY doc_id, ts, te),
looks AS (SELECT DISTINCT doc_id, ts, te, true AS like_ FROM at_ WHERE label = 'IP_ADDRESS' AND u < 0.7),
sizes AS (SELECT doc_id, len(regexp_extract_all(text, {X._quoted(S.vocab.TOKEN)})) AS n FROM documents),
firsts AS (SELECT doc_id, n, unnest(range(0, n)) AS ts FROM sizes),
every AS (SELECT doc_id, ts, unnest(range(ts, least(ts + 12, n))) AS te FROM firsts)"""
_LABELLED = _SUPERVISED + f""",
held AS (SELECT doc_id, ts, te FROM types UNION SELECT doc_id, ts, te FROM senses UNION SELECT doc_id, ts, te FROM at_),
chosen_ AS (SELECT e.* FROM every e LEFT JOIN held h ON e.doc_id = h.doc_id AND e.ts = h.ts AND e.te = h.te WHERE h.doc_id IS NOT NULL OR {_U("'neg:' || e.doc_id || ':' || e.ts || ':' || e.te")} <= 0.2),
cands AS (SELECT * FROM chosen_ UNION ALL SELECT doc_id, 0, 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chosen_)),
tt AS (SELECT c.doc_id, c.ts, c.te, g.label, min(g.o) AS o, list_distinct(flatten(list(range(g.ts, g.te + 1)))) AS l FROM cands c JOIN types g ON c.doc_id = g.doc_id AND g.ts <= c.te AND c.ts <= g.te GROUP BY c.doc_id, c.ts, c.te, g.label),
ti AS (SELECT doc_id, ts, te, label, o, len(list_filter(l, lambda x: x >= ts AND x <= te)) / (te - ts + 1 + len(l) - len(list_filter(l, lambda x: x >= ts AND x <= te))) AS iou FROM tt),
tb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ts, te ORDER BY iou DESC, o) AS rn FROM ti),
st AS (SELECT c.doc_id, c.ts, c.te, g.label, min(g.o) AS o, list_distinct(flatten(list(range(g.ts, g.te + 1)))) AS l FROM cands c JOIN senses g ON c.doc_id = g.doc_id AND g.ts <= c.te AND c.ts <= g.te GROUP BY c.doc_id, c.ts, c.te, g.label),
si AS (SELECT doc_id, ts, te, label, o, len(list_filter(l, lambda x: x >= ts AND x <= te)) / (te - ts + 1 + len(l) - len(list_filter(l, lambda x: x >= ts AND x <= te))) AS iou FROM st),
sb AS (SELECT *, row_number() OVER (PARTITION BY doc_id, ts, te ORDER BY iou DESC, o) AS rn FROM si),
q AS (SELECT c.doc_id, c.ts, c.te, coalesce(t.label, 'NONE') AS label, s.label AS sensitivity, coalesce(t.label, b.label, 'NONE') AS best_label, round(CASE WHEN t.label IS NOT NULL OR b.label IS NULL THEN 1.0::DOUBLE ELSE b.iou END, 6) AS weight,
  round(CASE WHEN like_ THEN 0.8::DOUBLE WHEN s.label = 'REDACT' THEN 1.0 WHEN s.label = 'KEEP' THEN 0.0 WHEN d.label = 'REDACT' THEN d.iou WHEN d.label = 'KEEP' THEN 1 - d.iou ELSE 0.0 END, 6) AS redact
  FROM cands c LEFT JOIN types t USING (doc_id, ts, te) LEFT JOIN senses s USING (doc_id, ts, te) LEFT JOIN looks USING (doc_id, ts, te) LEFT JOIN (SELECT * FROM tb WHERE rn = 1) b USING (doc_id, ts, te) LEFT JOIN (SELECT * FROM sb WHERE rn = 1) d USING (doc_id, ts, te))"""
ORACLES = {
    "candidate_labels": _LABELLED + " SELECT doc_id, label, sensitivity, best_label, weight, redact, count(*) AS n, CAST(sum(ts) AS BIGINT) AS sum_ts, CAST(sum(te) AS BIGINT) AS sum_te FROM q GROUP BY ALL",
    "decode_by_label": "WITH" + X.GOLD + X.PRED + S._ORD.replace("ordered AS", "allp AS") + ", ordered AS (SELECT * FROM allp WHERE score >= CASE label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items()) + f" ELSE {LEAST_OTHER} END)," + S._BY_LABEL + S._fold("flat", "-score, first, ord", f"{S._RATIO} > 0.70"),
}
