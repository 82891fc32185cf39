"""Rows by their place: in an order, or in files as they stand there; and tables joined place by place.

A row's place is data before anything is counted or joined: the table is written once with what its order was in a
task, so counts and rows can't come from two evaluations that were dealt differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared

#: Bits of a monotonically increasing id that count inside a partition.
_BITS = 33


def _numbered(rows: DataFrame, runs: list[str]) -> DataFrame:
    """rows with _row: _id increases within a run, and runs follow each other in their own order."""
    counts = rows.groupBy(*runs).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # a row for each partition or block of a file
    before = Window.orderBy(*runs).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*(F.col(c).alias(f"_of{c}") for c in runs), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = [F.col(c) == F.col(f"_of{c}") for c in runs]
    joined = rows.join(starts, same)
    return joined.withColumn("_row", F.col("_start") + F.col("_id") - F.col("_first")).drop("_id", "_first", "_start", *runs, *(f"_of{c}" for c in runs))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _row, from 0 in ``order``, nulls first; rows that are equal there follow each other in any order. No task sees all rows. The result reads from a table in the shared folder."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return _numbered(shared.written(placed, "numbered").withColumn("_part", F.shiftright("_id", _BITS)), ["_part"])


def arrived(df: DataFrame) -> DataFrame:
    """df with _row, from 0 in the order in which its partitions give rows. The result reads from a table in the shared folder."""
    return _numbered(shared.written(df.withColumn("_id", F.monotonically_increasing_id()), "arrived").withColumn("_part", F.shiftright("_id", _BITS)), ["_part"])


def read_numbered(spark: SparkSession, paths: str | list[str], schema: str, mode: str = "FAILFAST") -> DataFrame:
    """JSON lines with _row: their place, from 0, in the files in the order of their paths, blank lines left out. Files are read in blocks, each by a task. The result reads from a table in the shared folder."""
    lines = spark.read.schema(schema).option("mode", mode).json(paths)
    placed = lines.select("*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    return _numbered(shared.written(placed, "lines"), ["_path", "_block"])


def _same_size(left: DataFrame, right: DataFrame, names: tuple[str, str]) -> None:
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} {names[0]} and {b} {names[1]}")


def with_companion(main: DataFrame, companion: DataFrame, order: list[str] | None = None) -> DataFrame:
    """main with sensitivity_spans of the companion's row at the same place; ValueError if their numbers of rows differ. order: what both are numbered by; without it they have _row from read_numbered() or numbered()."""
    if order is not None:
        main, companion = numbered(main, order), numbered(companion, order)
    _same_size(main, companion, ("rows", "companions"))
    side = companion.select("_row", F.col("sensitivity_spans").alias("_spans"))
    out = main.join(side, "_row", "left").withColumn("sensitivity_spans", F.col("_spans")).drop("_spans")
    return out.drop("_row") if order is not None else out


def paired(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """_row, pred and gold: the columns of the two rows at each place, as structs; ValueError if their numbers of rows differ. Both have _row."""
    _same_size(predicted, gold, ("predictions", "gold rows"))
    side = lambda df, name: df.select("_row", F.struct(*(c for c in df.columns if c != "_row")).alias(name))
    return side(predicted, "pred").join(side(gold, "gold"), "_row")
