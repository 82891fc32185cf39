"""Order-dependent choices within a document: non-overlapping spans, suppression, redaction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import intervals


def greedy(spans: Column, kind: str, clash) -> Column:
    """In the array's order, each span that clashes with none kept before. kind: the array's type."""
    return F.aggregate(spans, F.array().cast(kind), lambda kept, s: F.when(F.exists(kept, lambda k: clash(k, s)), kept).otherwise(F.array_append(kept, s)))


def _overlap(a: Column, b: Column) -> Column:
    return C.chars_overlap(a["start"], a["end"], b["start"], b["end"])


_SPAN = "array<struct<rank:double,size:bigint,start:bigint,end:bigint,label:string,score:double>>"


def _stay(spans: DataFrame, key: str, entry: Column, indices) -> DataFrame:
    """key, label, start, end, score of those of a document's spans that ``indices`` gives of their array, sorted by ``entry``."""
    rows = spans.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("s"))
    rows = rows.select(key, F.explode(intervals.picked(F.col("s"), indices(F.col("s")))).alias("k"))
    return rows.select(key, "k.label", "k.start", "k.end", "k.score")


def non_overlapping(spans: DataFrame, key: str) -> DataFrame:
    """key, label, start, end, score: by score down, length down, start, end, label, whatever overlaps nothing taken before."""
    entry = F.struct((-F.col("score")).alias("rank"), (F.col("start") - F.col("end")).alias("size"), "start", "end", "label", "score")
    return _stay(spans, key, entry, intervals.disjoint)


def suppressed(spans: DataFrame, key: str, iou: float = 0.5) -> DataFrame:
    """As non_overlapping(), but equal scores in the order of ``ord``, and also by intersection over union, which decides alone where it is 0 or less."""
    entry = F.struct((-F.col("score")).alias("rank"), "ord", "start", "end", "label", "score")
    return _stay(spans, key, entry, lambda s: intervals.disjoint(s, iou))


def suppressed_by_label(spans: DataFrame, key: str, same: float = 0.35, cross: float | None = 0.70) -> DataFrame:
    """Token-like spans: suppression within each label, then across labels, where overlap over the shorter span exceeds a bound.

    Labels come in the order in which ``ord`` first names them; that order decides between equal scores.
    """
    entry = F.struct((-F.col("score")).alias("rank"), "ord", "start", "end", "label", "score")
    return _stay(spans, key, entry, lambda s: intervals.by_label(s, same, cross))


def resolved(hits: Column) -> Column:
    """non_overlapping() of an array of struct(label, start, end, score) within the row: struct(start, end, label) in order."""
    entries = F.transform(hits, lambda h: F.struct((-h["score"]).alias("rank"), (h["start"] - h["end"]).alias("size"), h["start"].alias("start"), h["end"].alias("end"), h["label"].alias("label"), h["score"].alias("score"))).cast(_SPAN)
    return F.array_sort(F.transform(greedy(F.array_sort(entries), _SPAN, _overlap), lambda k: F.struct(k["start"].alias("start"), k["end"].alias("end"), k["label"].alias("label"))))


def _joined(text: Column, spans: Column, new) -> Column:
    """The text with each of the disjoint spans, in order, replaced by new(span): the pieces are made one by one and joined once. Null where a piece is."""

    def whole(spans: Column) -> Column:
        end = lambda k: F.coalesce(F.get(spans, k)["end"], F.lit(0))
        pieces = F.transform(spans, lambda s, i: F.concat(C.slice_text(text, F.when(i > 0, end(i - 1)).otherwise(0), s["start"]), new(s)))
        tail = C.slice_text(text, end(F.size(spans) - 1), F.length(text).cast("bigint"))
        joined = F.transform(F.array(pieces), lambda p: F.when(~F.exists(p, lambda x: x.isNull()), F.concat(F.array_join(p, ""), tail)))[0]
        return F.when(F.size(spans) > 0, joined).when(spans.isNotNull(), text)

    # the spans are found once, whatever finds them
    return F.transform(F.array(spans), whole)[0]


def replaced(text: Column, spans: Column, replacement) -> Column:
    """The text with each of the disjoint spans (start, end, label), in order, replaced by replacement(label, value)."""
    return _joined(text, spans, lambda s: replacement(s["label"], C.slice_text(text, s["start"], s["end"])))


def rewritten(docs: DataFrame, spans: DataFrame, key: str, text: str, replacement: Column) -> DataFrame:
    """docs with ``redacted`` and n_spans: each of the disjoint spans (label, start, end) replaced. ``replacement`` is made from F.col("label") and F.col("value")."""
    pieces = spans.join(docs.select(key, text), key).withColumn("value", C.slice_text(F.col(text), F.col("start"), F.col("end")))
    listed = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "end", replacement.alias("new")))).alias("spans"))
    done = _joined(F.col(text), F.coalesce("spans", F.array().cast("array<struct<start:bigint,end:bigint,new:string>>")), lambda s: s["new"])
    return docs.join(listed, key, "left").withColumns({"redacted": done, "n_spans": F.coalesce(F.size("spans"), F.lit(0)).cast("bigint")}).drop("spans")
