"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import conversation_repair, fingerprints, learned_partitions, near_duplicates, packing, quality_classifier, quality_rules, spelling_variants, substring_dedup, token_output, unigram, url_filters, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": quality_classifier.op1_quality_classifier,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_token_output": token_output.op3_token_output,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_packing": packing.op6_packing,
        "op7_near_duplicates": near_duplicates.op7_near_duplicates,
        "op8_warc": warc.op8_warc,
        "op9_unigram": unigram.op9_unigram,
        "op10_url_filters": url_filters.op10_url_filters,
        "op11_neighbours": learned_partitions.op11_neighbours,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_spelling_variants": spelling_variants.op13_spelling_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": substring_dedup.ORACLE,
        "op7_near_duplicates": near_duplicates.ORACLE,
        "op8_warc": warc.ORACLE,
        "op10_url_filters": url_filters.ORACLE,
        "op12_conversation_repair": conversation_repair.ORACLE,
        "op13_spelling_variants": spelling_variants.ORACLE,
    }
