"""Records of training: progress, stopping, thresholds that moved, soft scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stopped(epochs: DataFrame, run: str, losses: list[str], total: str, patience: int = 10, min_delta: float = 1e-3) -> DataFrame:
    """run, last_epoch, best_epoch, best: where each run (run, epoch, losses, total) ends and which of its epochs is best by then.

    An epoch makes progress if any of the losses falls by more than min_delta below its best; after ``patience``
    epochs without progress the run ends. The first epoch counts as the best until a lower total comes.
    """
    entry = F.struct("epoch", F.array(*losses).cast("array<double>").alias("l"), F.col(total).cast("double").alias("t"))
    start = F.struct(F.array(*(F.lit(float("inf")) for _ in losses)).alias("best"), F.lit(0).alias("idle"), F.lit(-1).cast("bigint").alias("last"), F.lit(-1).cast("bigint").alias("at"), F.lit(float("inf")).alias("low"))

    def step(acc: Column, x: Column) -> Column:
        falls = F.zip_with(acc["best"], x["l"], lambda b, v: ~F.isnan(v) & (v < b - max(0.0, min_delta)))
        best = F.zip_with(acc["best"], x["l"], lambda b, v: F.when(~F.isnan(v) & (v < b - max(0.0, min_delta)), v).otherwise(b))
        better = (acc["at"] < 0) | (~F.isnan(x["t"]) & (x["t"] < acc["low"]))
        now = F.struct(best.alias("best"), F.when(F.exists(falls, lambda f: f), 0).otherwise(acc["idle"] + 1).alias("idle"), x["epoch"].alias("last"), F.when(better, x["epoch"]).otherwise(acc["at"]).alias("at"), F.when(better, x["t"]).otherwise(acc["low"]).alias("low"))
        return F.when((acc["idle"] >= patience) & F.lit(patience > 0), acc).otherwise(now)

    rows = epochs.withColumn("epoch", F.col("epoch").cast("bigint")).groupBy(run).agg(F.aggregate(F.array_sort(F.collect_list(entry)), start, step).alias("r"))
    return rows.select(run, F.col("r.last").alias("last_epoch"), F.col("r.at").alias("best_epoch"), F.col("r.low").alias("best"))


def moved(old: DataFrame, new: DataFrame, most: int = 8) -> DataFrame:
    """label, old, new, delta of thresholds (label, threshold) that changed by over 1e-6, the ``most`` largest changes."""
    both = old.select("label", F.col("threshold").alias("old")).join(new.select("label", F.col("threshold").alias("new")), "label")
    return both.withColumn("delta", F.col("new") - F.col("old")).filter("abs(delta) > 1e-6").orderBy(F.desc(F.abs("delta")), "label").limit(most)


def overlap_weight(epoch: Column, start: int = 12, full: int = 36, most: float = 0.2) -> Column:
    """Weight of partly overlapping negatives: none before ``start``, then rising to ``most`` at ``full``."""
    ramp = F.lit(most) if full <= start else most * F.least(F.lit(1.0), (epoch - start) / (full - start))
    return F.when(epoch < start, F.lit(0.0)).otherwise(ramp)


def soft_f1_loss(rows: DataFrame, probabilities: str, label: str, classes: int, without_none: bool = True) -> DataFrame:
    """One row, loss: 1 less the mean over classes of F1 with probabilities as counts."""
    each = rows.select(label, F.posexplode(probabilities).alias("c", "p")).filter((F.col("c") >= int(without_none)) & (F.col("c") < classes))
    y = (F.col(label) == F.col("c")).cast("double")
    sums = each.groupBy("c").agg(F.sum(F.col("p") * y).alias("tp"), F.sum(F.col("p") * (1 - y)).alias("fp"), F.sum((1 - F.col("p")) * y).alias("fn"))
    f1 = (2 * F.col("tp") + 1e-9) / (2 * F.col("tp") + F.col("fp") + F.col("fn") + 1e-9)
    return sums.agg((1 - F.avg(f1)).alias("loss"))
