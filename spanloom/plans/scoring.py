"""Predictions against gold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C
from ..operators import evaluate as E
from . import fixtures as X

EXACT = ["doc_id", "label", "start", "end"]


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return X.pred(spark, sf), X.gold(spark, sf)


def match_exact(spark: SparkSession, sf: str) -> DataFrame:
    return E.matched(*_sides(spark, sf), EXACT)


def per_label_prf(spark: SparkSession, sf: str) -> DataFrame:
    return E.per_label(match_exact(spark, sf))


def micro_macro(spark: SparkSession, sf: str) -> DataFrame:
    """One row: counts over all documents, macro F1 over all labels and over those with support."""
    per = per_label_prf(spark, sf)
    total = E.with_rates(per.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn"))))
    macro = per.agg(F.round(F.avg("f1"), 6).alias("macro_f1"), F.round(F.coalesce(F.avg(F.when(F.col("support") > 0, F.col("f1"))), F.lit(0.0)), 6).alias("macro_f1_supported"))
    return total.crossJoin(macro)


def exact_match_rate(spark: SparkSession, sf: str) -> DataFrame:
    per = E.counted(match_exact(spark, sf), "doc_id")
    rows = X.documents(spark, sf).select("doc_id").join(per, "doc_id", "left").fillna(0)
    return rows.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("double")), 6).alias("exact_match_rate"))


def match_value(spark: SparkSession, sf: str) -> DataFrame:
    pred, gold = (d.withColumn("value", C.strip(F.col("value"))) for d in _sides(spark, sf))
    return E.matched(pred, gold, ["doc_id", "label", "value"])


def value_prf(spark: SparkSession, sf: str) -> DataFrame:
    return E.with_rates(E.counted(match_value(spark, sf), "label"))


def _numbered(df: DataFrame, name: str) -> DataFrame:
    """Characters stand for tokens: spans with inclusive ends, and their place in the document."""
    order = ["start", "end", "label"] + (["score"] if "score" in df.columns else [])
    w = Window.partitionBy("doc_id").orderBy(*order)
    return df.select("doc_id", "label", F.col("start").alias("ts"), (F.col("end") - 1).alias("te"), F.row_number().over(w).cast("bigint").alias(name))


def overlap_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pred, gold = _sides(spark, sf)
    return E.credit_pairs(_numbered(pred, "pi"), _numbered(gold, "gi"), "doc_id", same_label=True)


def soft_credit(spark: SparkSession, sf: str) -> DataFrame:
    return E.total_credit(overlap_pairs(spark, sf), "doc_id")


def soft_prf(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by credit: tp is the credit, fp and fn what is left of predictions and gold."""
    pred, gold = _sides(spark, sf)
    credit = soft_credit(spark, sf).agg(F.coalesce(F.sum("credit"), F.lit(0.0)).alias("credit"))
    sizes = pred.agg(F.count(F.lit(1)).alias("predicted")).crossJoin(gold.agg(F.count(F.lit(1)).alias("gold")))
    rows = credit.crossJoin(sizes)
    p, r, f1 = C.prf(F.col("credit"), F.col("predicted") - F.col("credit"), F.col("gold") - F.col("credit"))
    return rows.select(F.round("credit", 6).alias("credit"), "predicted", "gold", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def _related(spark: SparkSession, sf: str) -> DataFrame:
    pred, gold = (d.withColumn("value", C.strip(F.col("value"))) for d in _sides(spark, sf))
    return E.relationships(pred, gold, "doc_id")


def value_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return _related(spark, sf)


def merged_supersets(spark: SparkSession, sf: str) -> DataFrame:
    return E.merged_supersets(_related(spark, sf), "doc_id")


def error_taxonomy(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of kinds by predicted and by gold label, for kinds with one."""
    rows = merged_supersets(spark, sf)
    label = F.coalesce("pred_label", "gold_label")
    return rows.groupBy("kind", label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return E.confusion(_related(spark, sf), E.labels(X.documents(spark, sf)))


def error_examples(spark: SparkSession, sf: str) -> DataFrame:
    """The first five documents of each kind and label, with values cut to 220 characters."""
    rows = _related(spark, sf).filter("kind in ('fp', 'fn')").select("kind", F.coalesce("pred_label", "gold_label").alias("label"), "doc_id", C.compact(F.coalesce("pred_value", "gold_value")).alias("value"))
    w = Window.partitionBy("kind", "label").orderBy("doc_id", "value")
    return rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 5")


def error_example_keys(spark: SparkSession, sf: str) -> DataFrame:
    """In what order a report shows the labels of false positives and negatives."""
    rows = _related(spark, sf).filter("kind in ('fp', 'fn')").select("kind", F.coalesce("pred_label", "gold_label").alias("label"))
    return E.example_keys(rows, "kind", "label")


def wrong_place(spark: SparkSession, sf: str) -> DataFrame:
    return E.misplaced(*_sides(spark, sf), "doc_id")


def diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    pred, gold = _sides(spark, sf)
    return E.diagnosed(pred.select("doc_id", "label", "start", "end", "score"), gold, "doc_id")


def topk_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The three best predictions of each document."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "start", "end", "label")
    return X.pred(spark, sf).withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 3").select("doc_id", "rank", "label", "start", "end", "score")


def suspicious_spans(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.pred(spark, sf, with_text=True)
    return rows.select("doc_id", "label", "start", "end", "score", C.suspicious(F.col("text"), F.col("start"), F.col("end"), F.col("label")).alias("suspicious"))


QUERIES = {
    f.__name__: f
    for f in (match_exact, per_label_prf, micro_macro, exact_match_rate, match_value, value_prf, overlap_pairs, soft_credit, soft_prf, value_relationships, merged_supersets, error_taxonomy, confusion_matrix, error_examples, error_example_keys, wrong_place, diagnostics, topk_predictions, suspicious_spans)
}

_BOTH = "WITH" + X.GOLD + X.PRED
_STRIP = "regexp_replace({}, '^[\\t-\\r\\x1c-\\x1f \\x{{85}}\\p{{Z}}]+|[\\t-\\r\\x1c-\\x1f \\x{{85}}\\p{{Z}}]+$', '', 'g')"
_EXACT = """,
p AS (SELECT DISTINCT doc_id, label, start, "end" FROM pred), g AS (SELECT DISTINCT doc_id, label, start, "end" FROM gold),
m AS (SELECT doc_id, label, start, "end", CASE WHEN p.x AND g.x THEN 'tp' WHEN p.x THEN 'fp' ELSE 'fn' END AS kind FROM (SELECT *, true AS x FROM p) p FULL JOIN (SELECT *, true AS x FROM g) g USING (doc_id, label, start, "end"))"""
_LABELS = ", names AS (SELECT unnest([" + ", ".join(f"'{x}'" for x in vocab.LABELS) + "]) AS label)"
_COUNTS = "count(*) FILTER (kind = 'tp') AS tp, count(*) FILTER (kind = 'fp') AS fp, count(*) FILTER (kind = 'fn') AS fn"
_RATES = "round(CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 OR tp = 0 THEN 0.0::DOUBLE ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"
_PER = f", c AS (SELECT label, {_COUNTS} FROM m GROUP BY label), per AS (SELECT label, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM names LEFT JOIN c USING (label)), rated AS (SELECT *, {_RATES}, tp + fn AS support, tp + fp AS predicted FROM per)"
_VALUES = f""",
p AS (SELECT DISTINCT doc_id, label, {_STRIP.format('value')} AS value FROM pred), g AS (SELECT DISTINCT doc_id, label, {_STRIP.format('value')} AS value FROM gold)"""
_MATCHED = """,
m AS (SELECT doc_id, label, value, CASE WHEN p.x AND g.x THEN 'tp' WHEN p.x THEN 'fp' ELSE 'fn' END AS kind FROM (SELECT *, true AS x FROM p) p FULL JOIN (SELECT *, true AS x FROM g) g USING (doc_id, label, value))"""
_PAIRS = """,
np AS (SELECT doc_id, label, start AS ts, "end" - 1 AS te, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label, score) AS pi FROM pred),
ng AS (SELECT doc_id, label, start AS ts, "end" - 1 AS te, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label) AS gi FROM gold),
pairs AS (SELECT np.doc_id, pi, gi, CASE WHEN np.ts = ng.ts AND np.te = ng.te THEN 1.0::DOUBLE ELSE pow(2.0, -((np.te - np.ts + 1) + (ng.te - ng.ts + 1) - (least(np.te, ng.te) - greatest(np.ts, ng.ts) + 1))::DOUBLE) END AS credit
  FROM np JOIN ng ON np.doc_id = ng.doc_id AND np.label = ng.label AND greatest(np.ts, ng.ts) <= least(np.te, ng.te))"""
_CREDIT = """,
ranked AS (SELECT doc_id, list(struct_pack(c := credit, p := pi, g := gi) ORDER BY -credit, pi, gi) AS l FROM pairs GROUP BY doc_id),
chosen AS (SELECT doc_id, list_reduce(l[2:], lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.p = x.p OR k.g = x.g)) > 0 THEN acc ELSE list_append(acc, x) END, [l[1]]) AS l FROM ranked),
credited AS (SELECT doc_id, list_sum(list_transform(l, lambda x: x.c)) AS credit, len(l) AS pairs FROM chosen)"""
_RELATED = (
    _VALUES
    + _MATCHED
    + """,
lost AS (SELECT doc_id, list(struct_pack(label := label, value := value) ORDER BY label, value) AS g FROM m WHERE kind = 'fn' GROUP BY doc_id),
extra AS (SELECT doc_id, list(struct_pack(label := label, value := value) ORDER BY label, value) AS p FROM m WHERE kind = 'fp' GROUP BY doc_id),
sides AS (SELECT doc_id, coalesce(p, []) AS p, coalesce(g, []) AS g FROM extra FULL JOIN lost USING (doc_id)),
seeded AS (SELECT doc_id, list_prepend(struct_pack(x := struct_pack(label := '', value := ''), pool := g, out := []::STRUCT(kind VARCHAR, pred_label VARCHAR, pred_value VARCHAR, gold_label VARCHAR, gold_value VARCHAR)[]),
  list_transform(p, lambda x: struct_pack(x := x, pool := []::STRUCT(label VARCHAR, value VARCHAR)[], out := []::STRUCT(kind VARCHAR, pred_label VARCHAR, pred_value VARCHAR, gold_label VARCHAR, gold_value VARCHAR)[]))) AS l FROM sides),
walked AS (SELECT doc_id, list_reduce(l, lambda a, c: (
  [struct_pack(x := c.x, pool := CASE WHEN b IS NULL THEN a.pool ELSE list_filter(a.pool, lambda y: NOT (y.label = b.label AND y.value = b.value)) END,
    out := list_append(a.out, struct_pack(kind := CASE WHEN b IS NULL THEN 'fp' ELSE ['mismatch', 'subset', 'superset'][CAST(b.kind + 1 AS INT)] END, pred_label := c.x.label, pred_value := c.x.value, gold_label := b.label, gold_value := b.value)))
   for b in [list_sort(list_filter(list_transform(a.pool, lambda y: struct_pack(
      kind := CASE WHEN c.x.value = y.value AND c.x.label <> y.label THEN 0 WHEN c.x.value <> '' AND contains(y.value, c.x.value) AND c.x.value <> y.value THEN 1 WHEN y.value <> '' AND contains(c.x.value, y.value) AND c.x.value <> y.value THEN 2 ELSE 9 END,
      other := c.x.label <> y.label, gap := abs(length(c.x.value) - length(y.value)), label := y.label, value := y.value)), lambda r: r.kind < 9))[1]]])[1]) AS r FROM seeded),
related AS (
  SELECT doc_id, 'tp' AS kind, label AS pred_label, value AS pred_value, label AS gold_label, value AS gold_value FROM m WHERE kind = 'tp'
  UNION ALL SELECT doc_id, o.kind, o.pred_label, o.pred_value, o.gold_label, o.gold_value FROM (SELECT doc_id, unnest(r.out) AS o FROM walked)
  UNION ALL SELECT doc_id, 'fn', NULL, NULL, o.label, o.value FROM (SELECT doc_id, unnest(r.pool) AS o FROM walked))"""
)

_NORM = "lower(trim(regexp_replace({}, '\\s+', ' ', 'g')))".format
_SUPER, _MISSED, _PAIR = "STRUCT(pl VARCHAR, pv VARCHAR, g VARCHAR, p VARCHAR)", "STRUCT(label VARCHAR, value VARCHAR, g VARCHAR)[]", "STRUCT(label VARCHAR, value VARCHAR)[]"
_MERGED = f""",
bydoc AS (SELECT doc_id, list(struct_pack(pl := pred_label, pv := pred_value, g := {_NORM('gold_value')}, p := {_NORM('pred_value')}) ORDER BY pred_label, pred_value, gold_value) FILTER (kind = 'superset' AND pred_label = gold_label) AS s,
  list(struct_pack(label := gold_label, value := gold_value, g := {_NORM('gold_value')}) ORDER BY gold_label, gold_value) FILTER (kind = 'fn') AS f FROM related GROUP BY doc_id),
steps AS (SELECT doc_id, list_prepend(struct_pack(x := NULL::{_SUPER}, rest := coalesce(f, [])::{_MISSED}, merged := []::{_PAIR}, used := []::{_MISSED}),
  list_transform(coalesce(s, []::{_SUPER}[]), lambda x: struct_pack(x := x, rest := []::{_MISSED}, merged := []::{_PAIR}, used := []::{_MISSED}))) AS l FROM bydoc),
taken AS (SELECT doc_id, list_reduce(l, lambda a, c: (
  [CASE WHEN len(list_distinct(list_prepend(c.x.g, list_transform(ins, lambda m: m.g)))) >= 2 AND contains(c.x.p, c.x.g)
    THEN struct_pack(x := c.x, rest := list_filter(a.rest, lambda m: NOT list_contains(ins, m)), merged := list_append(a.merged, struct_pack(label := c.x.pl, value := c.x.pv)), used := list_concat(a.used, ins)) ELSE a END
   for ins in [list_filter(a.rest, lambda m: m.label = c.x.pl AND m.g <> '' AND contains(c.x.p, m.g))]])[1]) AS r FROM steps),
merged AS (SELECT doc_id, CASE WHEN kind = 'superset' AND len(list_filter(r.merged, lambda m: m.label = pred_label AND m.value = pred_value)) > 0 THEN 'merged' WHEN kind = 'fn' AND len(list_filter(r.used, lambda m: m.label = gold_label AND m.value = gold_value)) > 0 THEN 'used' ELSE kind END AS kind, pred_label, pred_value, gold_label, gold_value FROM related JOIN taken USING (doc_id))"""

_CARD = "length(regexp_replace(value, '[^0-9]', '', 'g'))"
ORACLES = {
    "match_exact": _BOTH + _EXACT + " SELECT * FROM m",
    "per_label_prf": _BOTH + _EXACT + _LABELS + _PER + " SELECT * FROM rated",
    "micro_macro": _BOTH + _EXACT + _LABELS + _PER + f", t AS (SELECT CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM per) SELECT t.*, {_RATES}, (SELECT round(avg(f1), 6) FROM rated) AS macro_f1, (SELECT round(coalesce(avg(f1) FILTER (support > 0), 0.0), 6) FROM rated) AS macro_f1_supported FROM t",
    "exact_match_rate": _BOTH + _EXACT + ", bad AS (SELECT DISTINCT doc_id FROM m WHERE kind <> 'tp') SELECT count(*) AS n_docs, round(avg(CASE WHEN bad.doc_id IS NULL THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS exact_match_rate FROM documents d LEFT JOIN bad USING (doc_id)",
    "match_value": _BOTH + _VALUES + _MATCHED + " SELECT * FROM m",
    "value_prf": _BOTH + _VALUES + _MATCHED + f", c AS (SELECT label, {_COUNTS} FROM m GROUP BY label) SELECT *, {_RATES} FROM c",
    "overlap_pairs": _BOTH + _PAIRS + " SELECT * FROM pairs WHERE credit > 0",
    "soft_credit": _BOTH + _PAIRS + _CREDIT + " SELECT * FROM credited",
    "soft_prf": _BOTH + _PAIRS + _CREDIT + ", s AS (SELECT (SELECT coalesce(sum(credit), 0.0::DOUBLE) FROM credited) AS c, (SELECT count(*) FROM pred) AS predicted, (SELECT count(*) FROM gold) AS gold) SELECT round(c, 6) AS credit, predicted, gold, round(CASE WHEN predicted = 0 THEN 0 ELSE c / predicted END, 6) AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE c / gold END, 6) AS recall, round(CASE WHEN predicted + gold = 0 THEN 0 ELSE 2 * c / (predicted + gold) END, 6) AS f1 FROM s",
    "value_relationships": _BOTH + _RELATED + " SELECT * FROM related",
    "merged_supersets": _BOTH + _RELATED + _MERGED + " SELECT * FROM merged",
    "error_taxonomy": _BOTH + _RELATED + _MERGED + " SELECT kind, coalesce(pred_label, gold_label) AS label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM merged GROUP BY ALL",
    "confusion_matrix": _BOTH + _RELATED + _LABELS + ", k AS (SELECT pred_label, gold_label, count(*) AS n FROM related WHERE kind = 'mismatch' GROUP BY ALL) SELECT a.label AS pred_label, b.label AS gold_label, coalesce(n, 0) AS n FROM names a CROSS JOIN names b LEFT JOIN k ON k.pred_label = a.label AND k.gold_label = b.label",
    "error_examples": _BOTH + _RELATED + ", e AS (SELECT kind, coalesce(pred_label, gold_label) AS label, doc_id, trim(regexp_replace(coalesce(pred_value, gold_value), '\\s+', ' ', 'g')) AS v FROM related WHERE kind IN ('fp', 'fn')), f AS (SELECT kind, label, doc_id, CASE WHEN length(v) > 220 THEN rtrim(substr(v, 1, 217)) || '...' ELSE v END AS value FROM e), n AS (SELECT *, row_number() OVER (PARTITION BY kind, label ORDER BY doc_id, value) AS rank FROM f) SELECT * FROM n WHERE rank <= 5",
    "error_example_keys": _BOTH + _RELATED + ", c AS (SELECT kind, coalesce(pred_label, gold_label) AS label, least(count(*), 20) AS n FROM related WHERE kind IN ('fp', 'fn') GROUP BY ALL) SELECT kind, label, n, row_number() OVER (PARTITION BY kind ORDER BY n DESC, label) AS place FROM c",
    "wrong_place": _BOTH + """, w AS (SELECT DISTINCT doc_id, label, start, "end" FROM pred p WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.doc_id = p.doc_id AND g.label = p.label AND g.start = p.start AND g."end" = p."end"))
SELECT w.doc_id, w.label, w.start, w."end", bool_or(greatest(w.start, g.start) < least(w."end", g."end")) AS overlaps FROM w JOIN gold g USING (doc_id, label) GROUP BY w.doc_id, w.label, w.start, w."end\"""",
    "diagnostics": _BOTH + """ SELECT p.doc_id, p.label, p.start, p."end", p.score, ['NO_OVERLAP', 'OVERLAP_DIFF_LABEL', 'OVERLAP_SAME_LABEL', 'EXACT'][CAST(max(CASE WHEN g.label IS NULL THEN 1 WHEN g.start = p.start AND g."end" = p."end" AND g.label = p.label THEN 4 WHEN g.label = p.label THEN 3 ELSE 2 END) AS INT)] AS verdict
FROM pred p LEFT JOIN gold g ON g.doc_id = p.doc_id AND greatest(g.start, p.start) < least(g."end", p."end") GROUP BY p.doc_id, p.label, p.start, p."end", p.score""",
    "topk_predictions": _BOTH + ', r AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, "end", label) AS rank, label, start, "end", score FROM pred) SELECT * FROM r WHERE rank <= 3',
    "suspicious_spans": _BOTH
    + f""", s AS (SELECT p.*, {_STRIP.format('p.value')} AS bare, CASE WHEN start > 0 THEN substr(text, start, 1) ELSE '' END AS b, substr(text, "end" + 1, 1) AS a FROM pred p JOIN documents USING (doc_id))
SELECT doc_id, label, start, "end", score, coalesce(CASE WHEN bare = '' THEN true WHEN label = 'EMAIL' THEN NOT regexp_matches(bare, '{vocab.WHOLE_EMAIL}') WHEN label = 'IP_ADDRESS' THEN NOT regexp_matches(bare, '{vocab.WHOLE_IP}')
  WHEN label = 'CREDIT_CARD' THEN {_CARD} < 13 OR regexp_matches(b, '^[0-9]$') OR regexp_matches(a, '^[0-9]$') WHEN label = 'ADDRESS' THEN regexp_matches(value, '[0-9]$') AND regexp_matches(a, '^[0-9]$') END, false) AS suspicious FROM s""",
}
