"""What calls cost, and where a budget ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions import columns as C


def prices(spark: SparkSession) -> DataFrame:
    """model, over (tokens above which the row holds), input, cached, output: a few dozen rows."""
    rows = [(m, -1, i, i if c is None else c, o) for m, (i, c, o) in vocab.PRICES.items()]
    for m, (low, high) in vocab.TIERED_PRICES.items():
        rows += [(m, over, i, i if c is None else c, o) for over, (i, c, o) in ((-1, low), (vocab.TIER_TOKENS, high))]
    return spark.createDataFrame(rows, "model string, over long, input double, cached double, output double")


def is_priced(model: Column) -> Column:
    """Whether a model has prices of its own."""
    return F.lower(C.strip(model)).isin([*vocab.PRICES, *vocab.TIERED_PRICES])


def priced(calls: DataFrame) -> DataFrame:
    """calls (model, input_tokens, cached_tokens, output_tokens) with cost_usd; an unknown model has the default's prices."""
    table = prices(calls.sparkSession)
    known = [*vocab.PRICES, *vocab.TIERED_PRICES]
    name = F.lower(C.strip(F.col("model")))
    name = F.when(name.isin(known), name).otherwise(vocab.DEFAULT_MODEL)
    tier = F.when(name.isin(list(vocab.TIERED_PRICES)) & (F.col("input_tokens") > vocab.TIER_TOKENS), vocab.TIER_TOKENS).otherwise(-1)
    cached = F.least("cached_tokens", "input_tokens")
    joined = calls.withColumns({"_model": name, "_over": tier.cast("bigint")}).join(table.select(F.col("model").alias("_model"), F.col("over").alias("_over"), "input", "cached", "output"), ["_model", "_over"])
    cost = (F.greatest(F.col("input_tokens") - cached, F.lit(0)) * F.col("input") + cached * F.col("cached") + F.col("output_tokens") * F.col("output")) / F.lit(1e6)
    return joined.withColumn("cost_usd", cost).drop("_model", "_over", "input", "cached", "output")


def budgeted(calls: DataFrame, group: str, order: list[str], cost: str, cap: float) -> DataFrame:
    """calls with running (cost so far) and within: whether the budget of its group held before the call."""
    upto = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running: Column = F.sum(cost).over(upto)
    return calls.withColumn("running", running).withColumn("within", F.col("running") - F.col(cost) < cap)
