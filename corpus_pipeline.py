"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return
the columns of docs. A stage's rows: see the stage functions of spanloom.llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import common, near_duplicates, packing, quality_classifier, quality_rules, substring_dedup

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier.stage),
    ("quality_rules", quality_rules.stage),
    ("near_duplicates", near_duplicates.stage),
    ("substring_dedup", substring_dedup.stage),
    ("packing", packing.stage),
]

#: SQL can express neither the fitted stages nor the packing: tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents table, by all stages; a stage's own tables go when its result is written.

    Nulls, empty and very long texts and repeated rows are as the stages have them; no documents give no rows.
    """
    docs, before = common.load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, f"stage-{name}")
        with common.held(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            common.delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
