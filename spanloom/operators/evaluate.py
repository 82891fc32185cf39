"""Predictions against gold: exact, by value, by overlap credit, by relationship; counts and rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C
from . import containment, intervals, tokens


def matched(pred: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """keys and kind (tp, fp, fn): the two sides as sets."""
    p = pred.select(*keys).distinct().withColumn("p", F.lit(True))
    g = gold.select(*keys).distinct().withColumn("g", F.lit(True))
    kind = F.when(F.col("p") & F.col("g"), "tp").when(F.col("p"), "fp").otherwise("fn")
    return p.join(g, keys, "full").select(*keys, kind.alias("kind"))


def counted(matches: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("tp", "fp", "fn")]
    return matches.groupBy(*by).agg(*counts)


def with_rates(counts: DataFrame) -> DataFrame:
    p, r, f1 = C.prf(*(F.col(c).cast("double") for c in ("tp", "fp", "fn")))
    return counts.withColumns({"precision": F.round(p, 6), "recall": F.round(r, 6), "f1": F.round(f1, 6)})


def labels(df: DataFrame) -> DataFrame:
    """The taxonomy as a table of a row for each label."""
    return df.sparkSession.createDataFrame([(name,) for name in vocab.LABELS], "label string")


def per_label(matches: DataFrame) -> DataFrame:
    """Counts and rates of every label of the taxonomy, zeros too."""
    counts = labels(matches).join(counted(matches, "label"), "label", "left").fillna(0)
    return with_rates(counts).withColumns({"support": F.col("tp") + F.col("fn"), "predicted": F.col("tp") + F.col("fp")})


def credit_pairs(pred: DataFrame, gold: DataFrame, key: str, same_label: bool) -> DataFrame:
    """key, pi, gi, credit > 0 of predictions (pi, ts, te, label) and gold (gi, ts, te, label) of one document, whose spans are swept by their starts."""
    keys = [key, "label"] if same_label else [key]
    side = lambda df, index: df.select(*keys, index, F.col("ts").alias("start"), (F.col("te") + 1).alias("end"))
    both = intervals.joined(side(pred, "pi"), side(gold, "gi"), keys, empties=True)
    credit = C.overlap_credit(F.col("l.start"), F.col("l.end") - 1, F.col("r.start"), F.col("r.end") - 1)
    return both.select(key, "l.pi", "r.gi", credit.alias("credit")).filter("credit > 0")


def total_credit(pairs: DataFrame, key: str) -> DataFrame:
    """key, credit, pairs: the best pairs first, each prediction and each gold span once."""
    ordered = pairs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("credit")).alias("rank"), "pi", "gi"))).alias("o"))
    taken = ordered.select(key, intervals.picked(F.col("o"), intervals.one_to_one(F.col("o.pi"), F.col("o.gi"))).alias("r"))
    return taken.select(key, F.aggregate("r", F.lit(0.0), lambda acc, x: acc - x["rank"]).alias("credit"), F.size("r").cast("bigint").alias("pairs"))


def relationships(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """key, kind, pred_label, pred_value, gold_label, gold_value of label/value sets.

    Exact matches first. Then each other prediction in order takes one gold value that is left: the same value
    (mismatch), one that contains it (subset), one that it contains (superset), by preference: kind, equal label,
    difference in length, label, value. Else it is an fp; gold values that no one took are fn.
    """
    pair = F.struct(F.col("label").cast("string").alias("label"), F.col("value").cast("string").alias("value"))
    p = pred.groupBy(key).agg(F.collect_set(pair).alias("p"))
    g = gold.groupBy(key).agg(F.collect_set(pair).alias("g"))
    rows = p.join(g, key, "full").select(key, containment.relationships(F.col("p"), F.col("g")).alias("rows"))
    return rows.select(key, F.explode("rows").alias("o")).select(key, "o.*")


def merged_supersets(related: DataFrame, key: str) -> DataFrame:
    """related with supersets whose parts are gold values (at least two, the missed ones of that label among them) as kind merged, and those missed ones as kind used.

    Values are compared in lower case with single spaces.
    """
    norm = lambda c, name: F.lower(C.collapse(F.col(c))).alias(name)
    rest = [c for c in related.columns if c not in (key, "kind")]
    rows = related.groupBy(key).agg(F.collect_list(F.struct("kind", *rest, norm("pred_value", "p"), norm("gold_value", "g"))).alias("rows"))
    known = F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in ("kind", "pred_label", "pred_value", "gold_label", "gold_value", "p", "g"))))
    rows = rows.select(key, "rows", containment.merged_kinds(known).alias("kinds"))
    rows = rows.select(key, F.explode(F.arrays_zip("rows", "kinds")).alias("z"))
    return rows.select(*(F.col(key) if c == key else F.col("z.kinds").alias("kind") if c == "kind" else F.col(f"z.rows.{c}").alias(c) for c in related.columns))


def example_keys(rows: DataFrame, kind: str, label: str, most: int = 20) -> DataFrame:
    """kind, label, n (examples kept of it, ``most`` at most) and place: in what order a report shows a kind's labels, those with most examples first, then by name."""
    counts = rows.groupBy(kind, label).agg(F.least(F.count(F.lit(1)), F.lit(most)).cast("bigint").alias("n"))
    # a row for each label of a kind
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(kind).orderBy(F.desc("n"), label)).cast("bigint"))


def diagnosed(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """pred with verdict: EXACT, OVERLAP_SAME_LABEL, OVERLAP_DIFF_LABEL or NO_OVERLAP."""
    both = intervals.joined(pred, gold.select(key, "label", "start", "end"), [key], outer=True)
    equal = lambda c: F.col(f"l.{c}") == F.col(f"r.{c}")
    level = F.when(F.col("r").isNull(), 0).when(equal("start") & equal("end") & equal("label"), 3).when(equal("label"), 2).otherwise(1)
    names = F.array(*map(F.lit, ("NO_OVERLAP", "OVERLAP_DIFF_LABEL", "OVERLAP_SAME_LABEL", "EXACT")))
    best = both.groupBy(key, "l").agg(F.max(level).alias("level"))
    return best.select(*(F.col(key) if c == key else F.col(f"l.{c}").alias(c) for c in pred.columns), F.get(names, F.col("level")).alias("verdict"))


def misplaced(pred: DataFrame, gold: DataFrame, key: str) -> DataFrame:
    """Predictions that aren't exact though their label is in the document's gold; overlaps: whether they touch one of that label."""
    wrong = pred.join(gold.select(key, "label", "start", "end").distinct(), [key, "label", "start", "end"], "left_anti")
    wrong = wrong.join(gold.select(key, "label").distinct(), [key, "label"], "left_semi")
    both = intervals.joined(wrong.select(key, "label", "start", "end").distinct(), gold.select(key, "label", "start", "end"), [key, "label"], outer=True)
    return both.groupBy(key, "label", F.col("l.start").alias("start"), F.col("l.end").alias("end")).agg(F.max(F.col("r").isNotNull()).alias("overlaps"))


def confusion(related: DataFrame, names: DataFrame) -> DataFrame:
    """pred_label, gold_label, n for all pairs of ``names`` (label), from mismatches; names are few."""
    grid = names.select(F.col("label").alias("pred_label")).crossJoin(names.select(F.col("label").alias("gold_label")))
    counts = related.filter("kind = 'mismatch'").groupBy("pred_label", "gold_label").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["pred_label", "gold_label"], "left").fillna(0, ["n"])


def by_side(merged: DataFrame) -> DataFrame:
    """kind, side, label, n from merged_supersets(): counts of each kind by predicted or by gold label, as the kind has them.

    Supersets that were merged count as tp and as merged_to_tp, and missed values that they used as nothing. A label
    that is null or blank is UNKNOWN.
    """
    sides = {"tp": ["pred"], "merged": ["pred"], "fp": ["pred"], "fn": ["gold"], "subset": ["pred", "gold"], "superset": ["pred", "gold"], "mismatch": ["pred", "gold"]}
    each = F.array(*(F.struct(F.lit(k).alias("of"), F.lit("tp" if k == "merged" else k).alias("kind"), F.lit(side).alias("side"), C.safe_label(F.col(f"{side}_label")).alias("label")) for k, of in sides.items() for side in of), F.struct(F.lit("merged").alias("of"), F.lit("merged_to_tp").alias("kind"), F.lit("pred").alias("side"), C.safe_label(F.col("pred_label")).alias("label")))
    rows = merged.select("kind", F.explode(each).alias("e")).filter(F.col("kind") == F.col("e.of"))
    return rows.groupBy("e.kind", "e.side", "e.label").agg(F.count(F.lit(1)).alias("n"))


def totals(sides: DataFrame) -> DataFrame:
    """One row from by_side(): how many of each kind, and the labels that occur, in order."""
    kinds = {"tp": "pred", "merged_to_tp": "pred", "fp": "pred", "fn": "gold", "subset": "gold", "superset": "gold", "mismatch": "gold"}
    counts = [F.coalesce(F.sum(F.when((F.col("kind") == k) & (F.col("side") == side), F.col("n"))), F.lit(0)).alias(f"n_{k}") for k, side in kinds.items()]
    return sides.agg(*counts, F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def label_accuracy(pred: DataFrame, gold: DataFrame, places: list[str]) -> DataFrame:
    """One row: of all places with a predicted or a gold label (NONE for the other side) how many agree, and of those with a gold label."""
    p = pred.groupBy(*places).agg(F.min("label").alias("p"))
    g = gold.groupBy(*places).agg(F.min("label").alias("g"))
    both = p.join(g, places, "full").select(F.coalesce("p", F.lit("NONE")).alias("p"), F.coalesce("g", F.lit("NONE")).alias("g"))
    same, real = F.col("p") == F.col("g"), F.col("g") != "NONE"
    rate = lambda part, whole: F.round(C.safe_div(F.count_if(part).cast("double"), F.count_if(whole).cast("double")), 6)
    return both.agg(F.count(F.lit(1)).alias("n_places"), rate(same, F.lit(True)).alias("accuracy"), rate(same & real, real).alias("positive_accuracy"))


def tag_accuracy(docs: DataFrame, pred: DataFrame, gold: DataFrame, key: str, text: str, specials: bool = False) -> DataFrame:
    """One row: n_tokens, the tokens of all docs (key, text), and the share of them whose tags from the spans (key, start, end) of both sides are equal; special tokens are left out."""
    listed = lambda side, name: side.groupBy(key).agg(F.collect_list(F.struct("start", "end")).alias(name))
    rows = docs.select(key, text).join(listed(pred, "p").join(listed(gold, "g"), key, "full"), key, "left")
    tags = rows.select(*(tokens.bio(F.col(text), F.col(f"{side}.start"), F.col(f"{side}.end"), specials).alias(side) for side in "pg"))
    both = F.filter(F.arrays_zip("p", "g"), lambda t: t["g"] != tokens.IGNORED)
    counts = tags.select(F.size(both).alias("n"), F.size(F.filter(both, lambda t: t["p"] == t["g"])).alias("same"))
    n = F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")
    return counts.agg(n.alias("n_tokens"), F.round(C.safe_div(F.coalesce(F.sum("same"), F.lit(0)).cast("double"), n.cast("double")), 6).alias("tag_accuracy"))


def probability_errors(rows: DataFrame, probability: str, target: str) -> DataFrame:
    """One row: n, accuracy at one half, mean absolute and mean squared error of probabilities of a target of 0 or 1; rows with a null target are left out."""
    p, t = F.col(probability), F.col(target).cast("double")
    known = rows.filter(F.col(target).isNotNull())
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)
    return known.agg(F.count(F.lit(1)).alias("n"), mean(((p >= 0.5).cast("double") == t).cast("double")).alias("accuracy"), mean(F.abs(p - t)).alias("mae"), mean((p - t) * (p - t)).alias("brier"))


def metric_diagnostics(per: DataFrame, misplaced_: DataFrame, least_support: int = 20, top: int = 5) -> DataFrame:
    """One row from per_label() and misplaced(): false positives and negatives for each hit (infinite without one), the share of misplaced predictions that touch gold, the labels most often predicted, and those with support but no hit."""
    ratio = lambda c: F.when(F.sum("tp") > 0, F.round(F.sum(c) / F.when(F.sum("tp") > 0, F.sum("tp")), 6)).otherwise(F.lit(float("inf")))
    ranked = F.array_sort(F.collect_list(F.when(F.col("predicted") > 0, F.struct((-F.col("predicted")).alias("r"), "label", "predicted"))))
    named = F.transform(F.slice(ranked, 1, top), lambda x: F.concat_ws(":", x["label"], x["predicted"]))
    dead = F.array_sort(F.collect_list(F.when((F.col("support") >= least_support) & (F.col("tp") == 0), F.col("label"))))
    counts = per.agg(ratio("fp").alias("fp_per_tp"), ratio("fn").alias("fn_per_tp"), F.array_join(named, ",").alias("top_labels"), F.array_join(dead, ",").alias("dead_labels"))
    share = misplaced_.agg(F.count(F.lit(1)).alias("wrong_place"), F.count_if("overlaps").alias("wrong_place_overlap"))
    share = share.withColumn("overlap_share", F.round(C.safe_div(F.col("wrong_place_overlap").cast("double"), F.col("wrong_place").cast("double")), 6))
    return counts.crossJoin(share)  # a row each
