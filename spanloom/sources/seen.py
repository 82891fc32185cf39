"""A history of texts beside an output: digests by prefix, so that a run reads and extends only what its own texts touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import records

#: Hexadecimal digits of a digest that name its folder: at most 4096 of them, which is what the driver may hold.
PREFIX = 3


def digest(text: Column) -> Column:
    """Of null another than of any text."""
    return F.coalesce(F.sha2(text, 256), F.lit("-" * 64))


def first_of_each(new: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Of the rows of ``new`` with one text (null is one, too) the first in ``order``, nulls last, with its digest as _digest; rows equal in all columns count as one, and of others with an equal ``order`` that of the least hash stays."""
    rows = new.withColumns({"_digest": digest(F.col(text)), "_hash": F.xxhash64(*(F.col(f"`{c}`").cast("string") if new.schema[c].dataType.typeName() in ("map", "variant") else F.col(f"`{c}`") for c in new.columns))})
    place = lambda: F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("at"), F.col("_hash").alias("h"))
    first = rows.groupBy("_digest").agg(F.min(place()).alias("_first")).withColumnRenamed("_digest", "_of")
    kept = rows.join(first, (F.col("_digest") == F.col("_of")) & (F.col("_hash") == F.col("_first.h")) & F.col(order).eqNullSafe(F.col("_first.at")))
    return kept.dropDuplicates(["_digest"]).drop("_hash", "_of", "_first")


def unseen(new: DataFrame, seen: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Rows whose text neither ``seen`` nor an earlier row of ``new`` has; see first_of_each(). A null text is seen where ``seen`` has one."""
    old = seen.select(digest(F.col(text)).alias("_digest")).distinct()
    return first_of_each(new.join(old, digest(new[text]) == old["_digest"], "left_anti"), text, order).drop("_digest")


def _digests(spark: SparkSession, path: str) -> DataFrame:
    schema = "digest string, prefix string"
    if records.first_existing(spark, [path]) is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def scan(spark: SparkSession, path: str) -> tuple[int, DataFrame]:
    """How many different texts the history at ``path`` has, and their digests; a history that isn't there has none."""
    found = _digests(spark, path).select("digest").distinct()
    return found.count(), found


def touched(spark: SparkSession, path: str, digests: DataFrame) -> DataFrame:
    """The digests of the history whose prefix one of ``digests`` has: other folders aren't read."""
    prefixes = [r[0] for r in digests.select(F.substring("digest", 1, PREFIX)).distinct().collect()]
    return _digests(spark, path).filter(F.col("prefix").isin(prefixes))


def resumed(new: DataFrame, path: str, text: str = "text", order: str = "doc_id") -> DataFrame:
    """unseen() against the history at ``path``, with _digest for remember()."""
    spark = new.sparkSession
    mine = new.select(digest(F.col(text)).alias("digest")).distinct()
    # the history's side is thinned by the new digests first: it may be far larger
    old = touched(spark, path, mine).join(mine, "digest", "left_semi").select(F.col("digest").alias("_digest")).distinct()
    return first_of_each(new.join(old, digest(new[text]) == old["_digest"], "left_anti"), text, order)


def remember(rows: DataFrame, path: str) -> None:
    """Adds the digests of rows that resumed() gave, and were written, to the history. The same rows again do no harm."""
    added = rows.select(F.col("_digest").alias("digest"), F.substring("_digest", 1, PREFIX).alias("prefix"))
    added.repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)
