"""1. Quality classifier: regularised quadratic discriminant analysis of document statistics.

The two classes' means and covariances come from counts and sums that Spark takes over all labelled rows, so
the fit reads a few numbers whatever the table's size. A covariance is shrunk towards the pooled diagonal and
factored once; the score is a calibrated difference of the log densities, written as one DataFrame expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, statistics

#: Share of the pooled diagonal in a class's covariance, and the least standard deviation of a part.
SHRINK, FLOOR = 0.1, 0.03
#: Least score of rows that are predicted to have label 1.
THRESHOLD = 0.3
#: Log-density differences are calibrated within these bounds, in steps.
BOUND, STEP = 60.0, 0.25
#: Rows with this remainder of crc32(doc_id as text) modulo FOLDS are held out of the fit.
FOLDS, HELD_OUT = 5, 0


def vector(s: Column) -> list[Column]:
    """Square roots of shares and logarithms of ratios, with some words of a usual text added, so that short texts stay near the middle."""
    share = lambda part, whole, more: F.sqrt(s[part] / (s[whole] + F.lit(more)))
    return [
        share("n_symbols", "word_chars", 20.0),
        share("n_bangs", "word_chars", 20.0),
        share("n_capitals", "word_chars", 50.0),
        share("n_same_neighbours", "n_words", 20.0),
        F.log((s["n_distinct_words"] + 10.0) / (s["n_words"] + 10.0)),
        share("n_dup_lines", "n_lines", 5.0),
        F.log((s["word_chars"] + 100.0) / (s["n_words"] + 20.0)),
        share("n_repeat_words", "n_words", 50.0),
    ]


SIZE = 8


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


@dataclass
class Model:
    """share: of label 1. For each class: mean, inverse Cholesky factor and log determinant of the covariance. Then the calibration's slope and offset."""

    share: float
    classes: list[tuple[np.ndarray, np.ndarray, float]] = field(default_factory=list)
    slope: float = 1.0
    offset: float = 0.0

    def difference(self, x: list[Column]) -> Column:
        """Log density under label 1 less that under label 0."""
        logs = []
        for mean, inverse, log_det in self.classes:
            total = F.lit(-0.5 * log_det)
            for i in range(SIZE):
                part = F.lit(0.0)
                for j in range(i + 1):
                    part = part + float(inverse[i, j]) * (x[j] - float(mean[j]))
                total = total - 0.5 * part * part
            logs.append(total)
        return F.greatest(F.least(logs[1] - logs[0], F.lit(BOUND)), F.lit(-BOUND))

    def score(self, x: list[Column]) -> Column:
        if not self.classes:
            return F.lit(self.share)
        return 1.0 / (1.0 + F.exp(-(self.slope * self.difference(x) + self.offset)))


def _calibrate(bins: list[tuple[float, int, int]], share: float) -> tuple[float, float]:
    """Logistic regression of the label on the difference, from (difference, rows of label 0, of label 1), by Newton's method.

    The targets are drawn in from 0 and 1 by a row each, so that classes that lie apart have a finite slope.
    """
    z = np.array([b[0] for b in bins])
    n = np.array([[b[1], b[2]] for b in bins], float)
    zeros, ones = n.sum(axis=0)
    target = np.array([1 / (zeros + 2), (ones + 1) / (ones + 2)])
    w = np.array([0.1, np.log(share / (1 - share))])
    x = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        gradient = x.T @ (n.sum(axis=1) * p - n @ target) + 1e-3 * w
        hessian = (x * (n.sum(axis=1) * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w = w - step * min(1.0, 1.0 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-6)), float(w[1])


def fit(rows: DataFrame, labels: DataFrame, scratch: common.Scratch) -> Model:
    """From rows (doc_id, x0, x1, ...) and labels (doc_id, quality). A document that is labelled more than once has its highest label.

    Without rows of both labels the model gives every text the share of label 1, or 0.5 if there is no label.
    """
    labels = labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("label")).filter("label is not null and doc_id is not null")
    labels = scratch.table(labels, "labels")
    known = scratch.table(rows.filter(~held_out(F.col("doc_id"))).join(labels, "doc_id"), "labelled")
    names = [f"x{i}" for i in range(SIZE)]
    products = [(i, j) for i in range(SIZE) for j in range(i + 1)]
    sums = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(c) for c in names), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"p{i}_{j}") for i, j in products))
    found = {r["label"]: r for r in sums.collect()}  # two rows
    if not (0 in found and 1 in found):
        return Model(0.5 if not found else float(1 in found))
    means, covariances, counts = [], [], []
    for label in (0, 1):
        r = found[label]
        mean = np.array([r[c] for c in names]) / r["n"]
        second = np.zeros((SIZE, SIZE))
        for i, j in products:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        means.append(mean)
        covariances.append(second - np.outer(mean, mean))
        counts.append(r["n"])
    pooled = sum(c * n for c, n in zip(covariances, counts, strict=True)) / sum(counts)
    model = Model(counts[1] / sum(counts))
    for mean, cov in zip(means, covariances, strict=True):
        factor = np.linalg.cholesky((1 - SHRINK) * cov + SHRINK * np.diag(np.diag(pooled)) + FLOOR**2 * np.eye(SIZE))
        model.classes.append((mean, np.linalg.inv(factor), 2 * float(np.log(np.diag(factor)).sum())))
    bin_ = F.round(model.difference([F.col(c) for c in names]) / STEP).cast("int")
    bins = known.groupBy(bin_.alias("bin")).agg(F.count_if(F.col("label") == 0).alias("zeros"), F.count_if(F.col("label") == 1).alias("ones"))
    counted = [(r["bin"] * STEP, r["zeros"], r["ones"]) for r in bins.orderBy("bin").collect()]  # at most 2 * BOUND / STEP + 1 rows
    model.slope, model.offset = _calibrate(counted, model.share)
    return model


def _judged(docs: DataFrame, labels: DataFrame, scratch: common.Scratch) -> tuple[DataFrame, DataFrame]:
    """doc_id, k1, k2 and verdict of each row of docs, and the table that they read from: it has the statistics, not the texts."""
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", *common.row_key(F.col("doc_id"), text), text.alias("text"))
    stats = statistics.add(rows, "text", "s").select("doc_id", "k1", "k2", *(v.alias(f"x{i}") for i, v in enumerate(vector(F.col("s")))))
    rows = scratch.table(stats, "statistics")
    score = fit(rows, labels, scratch).score([F.col(f"x{i}") for i in range(SIZE)])
    verdict = F.struct(held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), F.when(score >= THRESHOLD, 1).otherwise(0).alias("predicted"))
    return rows.select("doc_id", "k1", "k2", verdict.alias("verdict")), rows


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1; higher: label 1 is likelier) and predicted (1 if score >= THRESHOLD) of each row of docs.

    A null text is an empty one; a text of any length is counted as a whole. A null doc_id has no label. Rows that
    repeat get equal scores; lang, source and other columns of docs have no part in them. No rows give none. The
    result reads from a table of statistics in the shared folder.
    """
    with common.scratch(docs.sparkSession) as scratch:
        judged, table = _judged(docs, labels, scratch)
        scratch.keep(table)
        return judged.select("doc_id", "verdict.held_out", "verdict.score", "verdict.predicted")


def scored(docs: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """docs with the struct column ``name`` of what scores() gives for each row."""
    with common.scratch(docs.sparkSession) as scratch:
        judged, _ = _judged(docs, labels, scratch)
        found = scratch.table(judged.groupBy("k1", "k2").agg(F.first("verdict").alias(name)), "verdicts")
        scratch.keep(found)
        return common.with_rows(docs, found, name)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels").select("doc_id", "quality"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs with predicted 1. Rows that repeat stay or go together; no rows give none."""
    name = statistics.fresh(docs, "verdict")
    return scored(docs, common.load(spark, sf_dir, "labels").select("doc_id", "quality"), name).filter(F.col(name)["predicted"] == 1).drop(name)
