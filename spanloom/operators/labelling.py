"""Every candidate span of a document with its training targets, made in the document's task: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import negatives

#: A gold span on tokens; equal places stand once, in the order in which they were first seen.
PLACED = "array<struct<ts:bigint,te:bigint,label:string>>"
PLACES = "array<struct<ts:bigint,te:bigint>>"


def placed(spans: DataFrame, key: str, label: str, order: Column) -> DataFrame:
    """key and gold: PLACED from token spans (key, ts, te, ``label``), the last label of a place in ``order``; places in the order of their first."""
    per = spans.filter("ts is not null").groupBy(key, "ts", "te").agg(F.min(order).alias("o"), F.max_by(label, order).alias("label"))
    return per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "ts", "te", "label"))), lambda g: F.struct(g["ts"].alias("ts"), g["te"].alias("te"), g["label"].alias("label"))).alias("gold"))


def touching(gold: Column, ts: Column, te: Column) -> Column:
    return F.filter(gold, lambda g: (g["ts"] <= te) & (ts <= g["te"]))


def exact_label(gold: Column, ts: Column, te: Column) -> Column:
    return F.get(F.filter(gold, lambda g: (g["ts"] == ts) & (g["te"] == te)), F.lit(0))["label"]


def best_group(near: Column, ts: Column, te: Column) -> Column:
    """struct(iou, label): of the labels in ``near``, gold spans that touch the candidate, that whose spans' union is most like it, the first seen of equal ones; null without any."""

    def rated(label: Column, at: Column) -> Column:
        tokens = F.array_distinct(F.flatten(F.transform(F.filter(near, lambda g: g["label"] == label), lambda g: F.sequence(g["ts"], g["te"]))))
        common = F.size(F.filter(tokens, lambda t: (t >= ts) & (t <= te)))
        return F.struct((common / (te - ts + 1 + F.size(tokens) - common)).alias("iou"), (-at).alias("at"), label.alias("label"))

    return F.when(F.size(near) > 0, F.array_max(F.transform(F.array_distinct(F.transform(near, lambda g: g["label"])), rated)))


def enumerated(docs: DataFrame, key: str, most: int) -> DataFrame:
    """docs (key, n, ...) with ts, te of all token spans of at most ``most`` tokens; a document without tokens has none."""
    rows = docs.filter("n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("ts"))
    return rows.select("*", F.explode(F.sequence(F.col("ts"), F.least(F.col("ts") + (most - 1), F.col("n") - 1))).alias("te"))


def sampled(docs: DataFrame, key: str, rate: float, most: int = 12) -> DataFrame:
    """key, ts, te, label of the candidates of ``docs`` (key, n, types) that a gold span stands at, with its label, and of the share ``rate`` of the others that their digests choose, with null."""
    rows = negatives.sampled(docs, key, most, rate, ["types"], ["types"])
    return rows.select(key, "ts", "te", F.when(F.col("types").isNotNull(), exact_label(F.col("types"), F.col("ts"), F.col("te"))).alias("label"))


def labelled(docs: DataFrame, key: str, most: int = 12, rate: float | None = None, lookalike: float = 0.8, nothing: float = 1.0) -> DataFrame:
    """key, ts, te, label, sensitivity, best_label, weight, redact, keep of the candidates of ``docs``.

    docs: key, n (tokens), types and senses (PLACED; the latter with REDACT or KEEP as label), lookalikes and extra
    (PLACES). Candidates are all spans of at most ``most`` tokens; with ``rate``, of those that are neither in types
    nor in senses the share that their digests choose, and of the others all. Then come places of ``extra`` that
    aren't among these, if they aren't longer. A document that is left without any has one row for the place (0, 0).
    label is NONE, and sensitivity null, where no gold span stands at the very place. The soft targets: best_label
    has ``weight`` and NONE the rest; redact and keep sum to one.
    """
    ts, te = F.col("ts"), F.col("te")
    alike = F.transform("lookalikes", lambda g: F.struct(g["ts"].alias("ts"), g["te"].alias("te"), F.lit(None).cast("string").alias("label")))
    docs = docs.select(key, "n", "types", "senses", "extra", alike.alias("lookalikes"))
    near = negatives.sampled(docs, key, most, rate, ["types", "senses", "lookalikes"], ["types", "senses", "extra"], fallback=True)
    near = near.withColumnsRenamed({"types": "near", "senses": "near_senses"})
    # most candidates touch nothing
    like = F.exists("lookalikes", lambda g: (g["ts"] == ts) & (g["te"] == te))
    some = lambda c, value: F.when(F.col(c).isNotNull(), value)
    near = near.select(key, "ts", "te", some("near", exact_label(F.col("near"), ts, te)).alias("exact"), some("near_senses", exact_label(F.col("near_senses"), ts, te)).alias("sensitivity"), some("near", best_group(F.col("near"), ts, te)).alias("best"), some("near_senses", best_group(F.col("near_senses"), ts, te)).alias("sense"), some("lookalikes", like).alias("like"))
    by_iou = F.when(F.col("sense.label") == "REDACT", F.col("sense.iou")).otherwise(1 - F.col("sense.iou"))
    redact = F.when(F.col("like"), lookalike).when(F.col("sensitivity").isNotNull(), (F.col("sensitivity") == "REDACT").cast("double")).when(F.col("sense").isNotNull(), by_iou).otherwise(1 - nothing)
    exact = F.when(F.col("exact") != "NONE", F.col("exact"))
    weight = F.when(exact.isNotNull() | F.col("best").isNull(), 1.0).otherwise(F.col("best.iou"))
    return near.select(key, "ts", "te", F.coalesce(exact, F.lit("NONE")).alias("label"), "sensitivity", F.coalesce(exact, F.col("best.label"), F.lit("NONE")).alias("best_label"), weight.alias("weight"), redact.alias("redact"), (1 - redact).alias("keep"))


def budgeted(docs: DataFrame, key: str, most: int = 12, hard_each: int = 2, easy_each: int = 6, without: int = 48) -> DataFrame:
    """key, ts, te, positive, hard of the candidates of ``docs`` (key, n, types) that a budget allows: all positives, and for each of them so many hard and easy negatives, or ``without`` of both of a document that has none, in the order of a permutation that the key fixes.

    A negative is hard if it shares a token with a gold span.
    """
    return negatives.budgeted(docs, key, most, hard_each, easy_each, without)


def share(docs: DataFrame, key: str, rate: float, most: int = 12) -> DataFrame:
    """key, ts, te, positive, hard of all positives of ``docs`` (key, n, types) and of the share ``rate`` of each document's other candidates, the first in the order of a permutation that the key fixes."""
    return negatives.shared(docs, key, most, rate)
