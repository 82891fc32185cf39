"""Structured Streaming: documents come in as JSON lines, redacted ones go out, each text once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab
from ..operators import detect, resolve


def kept(text: Column) -> Column:
    """The best non-overlapping pattern matches of a text, struct(start, end, label) in order, as one expression."""

    def scored(label: str, score: float) -> Callable[[Column], Column]:
        return lambda m: F.struct(F.lit(label).alias("label"), m["start"].alias("start"), m["end"].alias("end"), F.lit(score).alias("score"))

    return resolve.resolved(F.flatten(F.array(*(F.transform(detect.matches(text, p, vocab.NEEDED[k]), scored(k, vocab.PATTERN_SCORES[k])) for k, p in vocab.PATTERNS.items()))))


def marker(label: Column, value: Column) -> Column:
    return F.concat(F.lit("[REDACTED:"), label, F.lit("]"))


def redacted(text: Column) -> Column:
    """A text with its best non-overlapping pattern matches replaced, as one expression: no shuffle, so it streams."""
    return resolve.replaced(text, kept(text), marker)


def stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, ts timestamp", lateness: str = "1 hour") -> DataFrame:
    """New files of ``path``: doc_id, ts, redacted; texts seen within ``lateness`` are left out."""
    rows = spark.readStream.schema(schema).json(path).withWatermark("ts", lateness).withColumn("digest", F.sha2("text", 256))
    return rows.dropDuplicatesWithinWatermark(["digest"]).select("doc_id", "ts", redacted(F.col("text")).alias("redacted"))


def counted(events: DataFrame, window: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """Events (ts, event_type, value) of a stream or a table in tumbling windows."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
