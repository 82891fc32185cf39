"""Scores of candidate spans, from whatever gives them, and what follows: decoded, resolved, redacted."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C
from . import detect, intervals, resolve, tokens

#: From documents (key, text) to spans (key, label, start, end, score).
Scorer = Callable[[DataFrame, str, str], DataFrame]


def by_patterns(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Every pattern match with its label's fixed score."""
    score = F.element_at(F.create_map(*(F.lit(x) for kv in vocab.PATTERN_SCORES.items() for x in kv)), F.col("label"))
    return detect.pattern_spans(docs, key, text).withColumn("score", score)


def by_batches(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Scorer:
    """A model's function over Arrow batches of (key, text) that yields batches of (key, label, start, end, score)."""

    def scorer(docs: DataFrame, key: str, text: str) -> DataFrame:
        kind = docs.schema[key].dataType.simpleString()
        return docs.select(key, text).mapInArrow(function, f"{key} {kind}, label string, start long, end long, score double")

    return scorer


def by_logits(candidates: DataFrame, key: str, types: str, redact: str, docs: DataFrame, text: str = "text") -> DataFrame:
    """Token spans (key, ts, te) with logits of types and of (REDACT, KEEP) as spans: label, confidence, decision and their product as score. NONE, KEEP and NaN drop out."""
    p, s = C.softmax(F.col(types)), C.softmax(F.col(redact))
    names = F.array(*map(F.lit, vocab.TRAINING_LABELS))
    rows = candidates.select(key, "ts", "te", F.get(names, C.argmax(F.col(types))).alias("label"), F.array_max(p).alias("type_confidence"), F.get(s, F.lit(0)).alias("redact_probability"), (C.argmax(F.col(redact)) == 0).alias("redacts"))
    rows = rows.withColumn("score", F.col("type_confidence") * F.col("redact_probability")).filter("label <> 'NONE' and redacts and not isnan(score)")
    lists = rows.groupBy(key).agg(F.collect_list(F.struct("ts", "te", "label", "score", "type_confidence", "redact_probability")).alias("c"))
    placed = docs.select(key, text).join(lists, key).select(key, "c", tokens.positions(F.col(text), F.col("c.ts"), F.col("c.te")).alias("p"))
    each = placed.select(key, F.explode(F.arrays_zip("c", F.col("p.start").alias("start"), F.col("p.end").alias("end"))).alias("z")).filter("z.start is not null")
    return each.select(key, "z.c.label", "z.start", "z.end", "z.c.score", "z.c.type_confidence", "z.c.redact_probability")


def least_by_label(thresholds: dict[str, float], default: float, label: Column | None = None) -> Column:
    """The label's own threshold, or the default."""
    if not thresholds:
        return F.lit(default)
    named = F.create_map(*(F.lit(x) for kv in thresholds.items() for x in kv))
    return F.coalesce(F.try_element_at(named, F.col("label") if label is None else label), F.lit(default))


def _least(threshold: float | dict[str, float], label: Column | None = None) -> Column:
    """One for all, or by label with "" for the others."""
    if isinstance(threshold, dict):
        return least_by_label({k: v for k, v in threshold.items() if k}, threshold.get("", 0.5), label)
    return F.lit(threshold)


def decoded_by_label(scored: DataFrame, key: str, thresholds: dict[str, float], default: float = 0.2, same: float = 0.35, cross: float | None = 0.70) -> DataFrame:
    """Spans (key, ord, label, start, end, score) at or over their label's threshold, neither NONE nor NaN, suppressed within each label and then across labels."""
    rows = scored.filter((F.col("label") != "NONE") & ~F.isnan("score") & (F.col("score") >= least_by_label(thresholds, default)))
    return resolve.suppressed_by_label(rows, key, same, cross)


def decoded(scored: DataFrame, docs: DataFrame, key: str, text: str, threshold: float | dict[str, float] = 0.5, iou: float = 0.5) -> DataFrame:
    """Spans at or over the threshold (one for all, or by label with "" for the others), trimmed, and suppressed where they overlap."""
    rows = scored.filter((F.col("score") >= _least(threshold)) & ~F.isnan("score")).join(docs.select(key, text), key)
    rows = rows.withColumn("t", C.trimmed_span(F.col(text), F.col("start"), F.col("end"))).filter("t is not null").select(key, "label", "t.start", "t.end", "score")
    order = Window.partitionBy(key).orderBy("start", "end", "label", "score")
    return resolve.suppressed(rows.withColumn("ord", F.row_number().over(order).cast("bigint")), key, iou)


def infer(docs: DataFrame, key: str, text: str, scorer: Scorer = by_patterns, threshold: float | dict[str, float] = 0.5) -> DataFrame:
    """docs with redacted, n_spans and redactions (label, start, end, value, score; null without any): as decoded(), but a document's spans meet its text once, and all else is done in its row."""
    body = F.col(text)
    lists = scorer(docs, key, text).groupBy(key).agg(F.collect_list(F.struct("label", "start", "end", "score")).alias("_scored"))
    good = F.filter("_scored", lambda s: (s["score"] >= _least(threshold, s["label"])) & ~F.isnan(s["score"]))
    tried = F.transform(good, lambda s: F.struct((-s["score"]).alias("rank"), C.trimmed_span(body, s["start"], s["end"]).alias("t"), s["label"].alias("label"), s["score"].alias("score")))
    ranked = F.array_sort(F.transform(F.filter(tried, lambda s: s["t"].isNotNull()), lambda s: F.struct(s["rank"].alias("rank"), s["t"]["start"].alias("start"), s["t"]["end"].alias("end"), s["label"].alias("label"), s["score"].alias("score"))))
    rows = docs.join(lists, key, "left").withColumn("_ranked", ranked).drop("_scored")
    rows = rows.withColumn("_kept", F.array_sort(F.transform(intervals.picked(F.col("_ranked"), intervals.disjoint(F.col("_ranked"), 0.5)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), C.slice_text(body, s["start"], s["end"]).alias("value"), s["score"].alias("score")))))
    none = F.coalesce("_kept", F.array())
    redacted = F.when(F.size(none) > 0, resolve.replaced(body, F.col("_kept"), lambda label, _: F.concat(F.lit("[REDACTED:"), label, F.lit("]")))).otherwise(body)
    return rows.withColumns({"redacted": redacted, "n_spans": F.size(none).cast("bigint"), "redactions": F.when(F.size(none) > 0, F.col("_kept"))}).drop("_ranked", "_kept")


def merged_windows(scored: DataFrame, key: str, iou: float = 0.5) -> DataFrame:
    """Spans that overlapping windows gave: of equal ones (start, end, label) the highest score, the first window's on ties, then suppressed."""
    w = Window.partitionBy(key, "start", "end", "label").orderBy(F.desc("score"), "window")
    best = scored.withColumn("rn", F.row_number().over(w)).filter("rn = 1")
    order = Window.partitionBy(key).orderBy("window", "start", "end", "label")
    return resolve.suppressed(best.select(key, "label", "start", "end", "score", F.row_number().over(order).cast("bigint").alias("ord")), key, iou)
