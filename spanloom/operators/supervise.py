"""Training targets from annotations: merged maps, soft targets, BIO tags; thresholds, sampling, schedules, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C


#: Buckets of scores between 0 and 1.
BUCKETS = 4096


def merged_types(spans: DataFrame, key: str) -> DataFrame:
    """key, start, end, label from spans (origin "item" or "span", ord): the last item of a place wins; a span only where no item is."""
    order = F.struct((F.col("origin") == "item").alias("item"), F.when(F.col("origin") == "item", F.col("ord")).otherwise(-F.col("ord")).alias("at"))
    return spans.groupBy(key, "start", "end").agg(F.max_by("label", order).alias("label"))


def merged_sensitivity(spans: DataFrame, companions: DataFrame, key: str) -> DataFrame:
    """key, start, end, sensitivity: the last item's, overridden by companions'. A document with places but no sensitivity at all has all of them REDACT."""
    own = spans.filter(F.col("sensitivity").isNotNull()).select(key, "start", "end", "sensitivity", "ord", F.lit(0).alias("side"))
    over = companions.filter(F.col("sensitivity").isNotNull()).select(key, "start", "end", "sensitivity", "ord", F.lit(1).alias("side"))
    said = own.unionByName(over).groupBy(key, "start", "end").agg(F.max_by("sensitivity", F.struct("side", "ord")).alias("sensitivity"))
    places = spans.select(key, "start", "end").distinct()
    silent = places.join(said.select(key).distinct(), key, "left_anti").withColumn("sensitivity", F.lit("REDACT"))
    return said.unionByName(silent)


def first_merged(spans: DataFrame, key: str, by: list[str]) -> DataFrame:
    """One row for each ``by`` within a document: items before spans, the first of each."""
    w = Window.partitionBy(key, *by).orderBy((F.col("origin") != "item"), "ord")
    return spans.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def group_iou(candidates: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """key, ts, te, label, iou, first: a candidate's tokens against the union of all gold spans of a label that overlap it; first: the first of these by place."""
    g = gold.select(key, F.col("label"), F.col("ts").alias("gs"), F.col("te").alias("ge"))
    hit = candidates.join(g, key).filter("gs <= te and ts <= ge")
    union = F.array_distinct(F.flatten(F.collect_list(F.sequence("gs", "ge"))))
    out = hit.groupBy(key, "ts", "te", "label").agg(union.alias("u"), F.min(F.struct("gs", "ge", "label")).alias("first"))
    common = F.size(F.filter("u", lambda t: (t >= F.col("ts")) & (t <= F.col("te"))))
    return out.select(key, "ts", "te", "label", "first", (common / (F.col("te") - F.col("ts") + 1 + F.size("u") - common)).alias("iou"))


def soft_types(candidates: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """candidates with best_label, weight: an exact gold span's label with 1, else that of the highest group IoU (the label seen first on ties), else NONE with 1. NONE has what is left."""
    exact = gold.groupBy(key, "ts", "te").agg(F.max("label").alias("exact"))
    best = group_iou(candidates, gold, key).groupBy(key, "ts", "te").agg(F.min_by("label", F.struct(-F.col("iou"), "first")).alias("near"), F.max("iou").alias("iou"))
    out = candidates.join(exact, [key, "ts", "te"], "left").join(best, [key, "ts", "te"], "left")
    return out.select(*candidates.columns, F.coalesce("exact", "near", F.lit("NONE")).alias("best_label"), F.when(F.col("exact").isNotNull() | F.col("near").isNull(), F.lit(1.0)).otherwise(F.col("iou")).alias("weight"))


def soft_redaction(candidates: DataFrame, gold: DataFrame, lookalikes: DataFrame, key: str, lookalike: float = 0.8, nothing: float = 1.0) -> DataFrame:
    """candidates with redact, keep. Lookalike places first, then exact places, then the best group IoU over REDACT and KEEP, else KEEP = ``nothing``. gold has its sensitivity as label."""
    like = lookalikes.select(key, "ts", "te").distinct().withColumn("like", F.lit(True))
    exact = gold.groupBy(key, "ts", "te").agg(F.max("label").alias("exact"))
    best = group_iou(candidates, gold, key).groupBy(key, "ts", "te").agg(F.min_by(F.struct("iou", "label"), F.struct(-F.col("iou"), "first")).alias("near"))
    out = candidates.join(like, [key, "ts", "te"], "left").join(exact, [key, "ts", "te"], "left").join(best, [key, "ts", "te"], "left")
    near = F.when(F.col("near.label") == "REDACT", F.col("near.iou")).otherwise(1 - F.col("near.iou"))
    redact = F.when(F.col("like"), lookalike).when(F.col("exact").isNotNull(), (F.col("exact") == "REDACT").cast("double")).when(F.col("near").isNotNull(), near).otherwise(1 - nothing)
    return out.select(*candidates.columns, redact.alias("redact"), (1 - redact).alias("keep"))


def thresholds(scored: DataFrame, support: DataFrame, least: int = 40, default: float = 0.2) -> DataFrame:
    """label, support, examples, threshold, f1, default_used from scored (label, score, hit) and support (label, support): for each label the score that gives the best F1, the highest of equal ones.

    Counts are cumulated over buckets of scores first and then within each, so no task has all scores of a label.
    """
    hit, bucket = F.col("hit").cast("double"), F.floor(F.col("score") * BUCKETS).alias("bucket")
    points = scored.groupBy("label", "score").agg(F.sum(hit).alias("h"), F.count(F.lit(1)).alias("n")).select("label", "score", bucket, "h", "n")
    above = Window.partitionBy("label").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    wider = points.groupBy("label", "bucket").agg(F.sum("h").alias("h"), F.sum("n").alias("n"))
    wider = wider.select("label", "bucket", F.coalesce(F.sum("h").over(above), F.lit(0.0)).alias("h_above"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("n_above"))
    w = Window.partitionBy("label", "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    points = points.select("label", "bucket", "score", F.sum("h").over(w).alias("h"), F.sum("n").over(w).alias("n")).join(wider, ["label", "bucket"])
    points = points.select("label", "score", (F.col("h") + F.col("h_above")).alias("tp"), (F.col("n") + F.col("n_above")).alias("all")).join(support, "label")
    p = F.col("tp") / (F.col("all") + 1e-9)
    r = F.col("tp") / (F.col("tp") + F.greatest(F.col("support") - F.col("tp"), F.lit(0.0)) + 1e-9)
    points = points.withColumn("f1", F.round(2 * p * r / (p + r + 1e-9), 9))
    best = points.groupBy("label").agg(F.max(F.struct("f1", "score")).alias("best"), F.max("all").alias("examples"))
    out = support.join(best, "label", "left")
    used = (F.col("support") < least) | F.col("best").isNull()
    return out.select("label", "support", F.coalesce("examples", F.lit(0)).cast("bigint").alias("examples"), F.when(used, F.lit(default)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("best.score")))).alias("threshold"), F.when(used, F.lit(0.0)).otherwise(F.col("best.f1")).alias("f1"), used.alias("default_used"))


def sampled_negatives(rows: DataFrame, positive: Column, key: Column, rate: float) -> DataFrame:
    """All positives, and the others whose digest's number is at most ``rate``."""
    return rows.filter(positive | (C.uniform(key) <= rate))


def budgeted_negatives(rows: DataFrame, key: str, positive: str, hard: str, order: Column, hard_each: int = 2, easy_each: int = 6, without: int = 48) -> DataFrame:
    """All positives; of each document's hard and easy negatives as many for each positive, or ``without`` of them where there is none; the first in ``order``."""
    w = Window.partitionBy(key, positive, hard).orderBy(order)
    n = F.sum(F.col(positive).cast("int")).over(Window.partitionBy(key))
    any_ = F.row_number().over(Window.partitionBy(key, positive).orderBy(order))
    out = rows.withColumns({"_n": n, "_rank": F.row_number().over(w), "_any": any_})
    keep = F.col(positive) | F.when(F.col("_n") == 0, F.col("_any") <= without).when(F.col(hard), F.col("_rank") <= hard_each * F.col("_n")).otherwise(F.col("_rank") <= easy_each * F.col("_n"))
    return out.filter(keep).drop("_n", "_rank", "_any")


def keep_probability(target: Column, prevalence: Column) -> Column:
    """Share of the negatives to keep so that they are ``target`` of all, from their prevalence; within [0, 1]."""
    p = target * (1 - prevalence) / (prevalence * (1 - target))
    return F.when((prevalence <= 0) | (target >= 1), F.lit(1.0)).when(target <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))


def linear_schedule(start: float, end: Column | float, epoch: Column, full: int) -> Column:
    target = F.lit(end) if not isinstance(end, Column) else end
    return target if full <= 0 else start + (target - start) * F.greatest(F.lit(0), F.least(epoch, F.lit(full))) / full


def cross_entropy(probabilities: Column, label: Column) -> Column:
    """-ln p[label], null where the label is masked (-100)."""
    return F.when(label != -100, -F.log(F.get(probabilities, label.cast("int"))))


def soft_cross_entropy(probabilities: Column, target: Column) -> Column:
    """Against a target distribution, scaled to sum 1; null where any part is negative."""
    total = F.aggregate(target, F.lit(0.0), lambda a, x: a + x)
    pairs = F.zip_with(target, probabilities, lambda t, p: -t * F.log(F.greatest(p, F.lit(1e-8))))
    return F.when(~F.exists(target, lambda t: t < 0), F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x) / F.greatest(total, F.lit(1e-8)))


def weighted_sum(losses: dict[str, Column], weights: dict[str, float]) -> Column:
    """The losses times their weights, 1 where none is given."""
    total = F.lit(0.0)
    for name, loss in losses.items():
        total = total + weights.get(name, 1.0) * loss
    return total


def typed(spans: DataFrame) -> DataFrame:
    """Gold spans that types are learned from: with offsets, a label of the taxonomy that isn't NONE, and a category other than NON_PII_NUMBER."""
    known = F.col("label").isin(vocab.LABELS) & ~F.coalesce(F.col("category") == "NON_PII_NUMBER", F.lit(False))
    return spans.filter(F.col("start").isNotNull() & F.col("end").isNotNull() & known)


def redact_places(items: DataFrame, companions: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, end, value of the places to redact: the last item of a place whose category says so (key, start, end, category, value, ord), and companions of sensitivity REDACT (key, start, end, sensitivity, value, ord) where no item is, the first of a place. A missing value is taken from the document's text; rows without offsets are left out."""
    real = items.filter(F.coalesce(C.sensitivity(F.col("category")) == "REDACT", F.lit(False))).select(key, "start", "end", "value", F.lit(1).alias("side"), F.col("ord").alias("at"))
    more = companions.filter("sensitivity = 'REDACT'").select(key, "start", "end", "value", F.lit(0).alias("side"), (-F.col("ord")).alias("at"))
    best = real.unionByName(more).filter("start is not null and end is not null").groupBy(key, "start", "end").agg(F.max_by(F.struct("value"), F.struct("side", "at"))["value"].alias("value"))
    rows = best.join(docs.select(key, F.col(text).alias("_text")), key)
    return rows.select(key, "start", "end", F.coalesce("value", C.slice_text(F.col("_text"), F.col("start"), F.col("end"))).alias("value"))


def split(rows: DataFrame, group: str, key: str, part: int, whole: int) -> DataFrame:
    """rows with ``part``: train for the first part/whole of each group, rounded up, in the order of their digests, else valid.

    Rows are counted by the first digits of their digests, these counts cumulated, and rows ranked within equal first
    digits alone, so no task sorts a whole group.
    """
    rows = rows.withColumn("_d", F.md5(F.concat(F.lit("split:"), F.col(key).cast("string")))).withColumn("_p", F.substring("_d", 1, 4))
    counts = rows.groupBy(group, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(group)).alias("_all"))
    rank = F.row_number().over(Window.partitionBy(group, "_p").orderBy("_d", key))
    ranked = rows.withColumn("_rank", rank).join(counts, [group, "_p"])
    return ranked.select(key, F.when(F.col("_before") + F.col("_rank") <= F.ceil(F.col("_all") * part / whole), "train").otherwise("valid").alias("part"))
