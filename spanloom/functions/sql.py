"""The engine's expressions as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .. import vocab

_INTERSECTION = "greatest(0, least(e0, e1) - greatest(s0, s1) + 1)"
_SIZES = "(greatest(0, e0 - s0 + 1) + greatest(0, e1 - s1 + 1)"
_SPACE = vocab.SPACE.replace("\\", "\\\\")
_EDGES = f"^{_SPACE}+|{_SPACE}+$"
_SLICE = "substring(t, CAST(greatest(0, least(s, length(t))) + 1 AS INT), CAST(greatest(0, least(e, length(t)) - greatest(0, least(s, length(t)))) AS INT))"
FUNCTIONS = {
    "chars_overlap(s0 BIGINT, e0 BIGINT, s1 BIGINT, e1 BIGINT) RETURNS BOOLEAN": "greatest(s0, s1) < least(e0, e1)",
    "char_iou(s0 BIGINT, e0 BIGINT, s1 BIGINT, e1 BIGINT) RETURNS DOUBLE": "CASE WHEN greatest(s0, s1) >= least(e0, e1) THEN 0D ELSE (least(e0, e1) - greatest(s0, s1)) / (e0 - s0 + e1 - s1 - least(e0, e1) + greatest(s0, s1)) END",
    "overlap_credit(s0 BIGINT, e0 BIGINT, s1 BIGINT, e1 BIGINT) RETURNS DOUBLE": f"CASE WHEN s0 = s1 AND e0 = e1 THEN 1D WHEN {_INTERSECTION} = 0 THEN 0D ELSE power(2D, -CAST({_SIZES} - {_INTERSECTION}) AS DOUBLE)) END",
    "slice_text(t STRING, s BIGINT, e BIGINT) RETURNS STRING": "substring(t, CAST(greatest(0, least(s, length(t))) + 1 AS INT), CAST(greatest(0, least(e, length(t)) - greatest(0, least(s, length(t)))) AS INT))",
    "trim_span(t STRING, s BIGINT, e BIGINT) RETURNS STRUCT<start: BIGINT, end: BIGINT>": f"CASE WHEN regexp_replace({_SLICE}, '{_EDGES}', '') <> '' THEN struct(greatest(0, least(s, length(t))) + length({_SLICE}) - length(regexp_replace({_SLICE}, '^{_SPACE}+', '')) AS start, greatest(0, least(s, length(t))) + length({_SLICE}) - length(regexp_replace({_SLICE}, '^{_SPACE}+', '')) + length(regexp_replace({_SLICE}, '{_EDGES}', '')) AS end) END",
    "redact(t STRING, spans ARRAY<STRUCT<start: BIGINT, end: BIGINT, label: STRING>>) RETURNS STRING": "concat(array_join(transform(array_sort(spans), (x, i) -> concat(substring(t, CAST(IF(i = 0, 0, array_sort(spans)[greatest(i - 1, 0)].end) + 1 AS INT), CAST(x.start - IF(i = 0, 0, array_sort(spans)[greatest(i - 1, 0)].end) AS INT)), '[REDACTED:', x.label, ']')), ''), substring(t, CAST(coalesce(array_max(transform(spans, x -> x.end)), 0) + 1 AS INT), length(t)))",
    "f1(tp DOUBLE, fp DOUBLE, fn DOUBLE) RETURNS DOUBLE": "CASE WHEN tp = 0 THEN 0D ELSE 2 * tp / (2 * tp + fp + fn) END",
}


def register(spark: SparkSession) -> None:
    """Temporary functions; Catalyst puts their bodies in place, so they cost what the expressions cost."""
    for signature, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
