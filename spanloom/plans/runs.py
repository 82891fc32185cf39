"""Responses of models and records of training."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import progress, responses
from . import fixtures as X
from . import training


def response_examples(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as examples in fenced responses, parsed again; one in four has a marker without a value."""
    bad = F.col("turn") % 4 == 3
    text = F.concat(F.lit("[[REAL_PII:person|Ann]] says "), F.when(bad, F.lit("[[REAL_PII:ORG|]] ")).otherwise(F.lit("")), F.translate("text", "{}[]", "()()"))
    body = F.to_json(F.struct(F.array(F.struct(text.alias("annotated_text"))).alias("examples")))
    rows = X.table(spark, sf, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("call"), F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("content"))
    out = responses.examples(rows, "call", "content")
    return out.select("call", F.col("idx").cast("bigint").alias("idx"), F.md5("text").alias("text_md5"), F.size("items").cast("bigint").alias("n_items"), "error")


def usage_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts from usage objects in two namings."""
    n = F.length("text")
    new = F.to_json(F.struct(n.alias("prompt_tokens"), (n + 1).alias("completion_tokens"), F.struct((n * 2).alias("cached_tokens")).alias("prompt_tokens_details")))
    old = F.to_json(F.struct(n.alias("input_tokens"), F.lit("many").alias("output_tokens")))
    rows = X.table(spark, sf, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, new).otherwise(old).alias("usage"))
    return rows.select("conv_id", "turn", responses.usage(F.col("usage")).alias("u")).select("conv_id", "turn", "u.*")


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Events of a user as epochs of a run, in order, with losses that their digests give."""
    key = F.col("event_id").cast("string")
    return X.table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), C.uniform(F.concat(F.lit("a:"), key)).alias("a"), C.uniform(F.concat(F.lit("b:"), key)).alias("b"), C.uniform(F.concat(F.lit("t:"), key)).alias("t"))


def early_stopping(spark: SparkSession, sf: str) -> DataFrame:
    out = progress.stopped(_epochs(spark, sf), "run", ["a", "b"], "t", patience=3, min_delta=0.01)
    return out.withColumn("best", F.round("best", 6))


def threshold_changes(spark: SparkSession, sf: str) -> DataFrame:
    new = training.calibrate_thresholds(spark, sf).select("label", "threshold")
    out = progress.moved(new.select("label", F.lit(0.2).alias("threshold")), new)
    return out.withColumn("delta", F.round("delta", 6))


def soft_f1(spark: SparkSession, sf: str) -> DataFrame:
    rows = training._logits(spark, sf).select(C.softmax(F.col("x")).alias("p"), (F.col("label") % 14).alias("y"))
    return progress.soft_f1_loss(rows, "p", "y", 14).select(F.round("loss", 6).alias("loss"))


QUERIES = {f.__name__: f for f in (response_examples, usage_fields, early_stopping, threshold_changes, soft_f1)}

_U = X.UNIFORM.format
ORACLES = {
    "response_examples": "SELECT conv_id || '-' || turn AS call, 0::BIGINT AS idx, md5('Ann says ' || CASE WHEN turn % 4 = 3 THEN ' ' ELSE '' END || translate(text, '{}[]', '()()')) AS text_md5, 1::BIGINT AS n_items, CASE WHEN turn % 4 = 3 THEN 'empty value' END AS error FROM conversations",
    "usage_fields": "SELECT conv_id, turn, length(text) AS input_tokens, CASE WHEN turn % 2 = 0 THEN length(text) ELSE 0 END AS cached_tokens, CASE WHEN turn % 2 = 0 THEN length(text) + 1 ELSE 0 END AS output_tokens FROM conversations",
    "early_stopping": f"""
WITH e AS (SELECT user_id AS run, event_id AS epoch, {_U("'a:' || event_id")} AS a, {_U("'b:' || event_id")} AS b, {_U("'t:' || event_id")} AS t FROM events),
l AS (SELECT run, list_prepend(struct_pack(a := 'inf'::DOUBLE, b := 'inf'::DOUBLE, idle := 0, epoch := -1::BIGINT, at_ := -1::BIGINT, t := 'inf'::DOUBLE), list(struct_pack(a := a, b := b, idle := 0, epoch := epoch, at_ := -1::BIGINT, t := t) ORDER BY epoch)) AS l FROM e GROUP BY run),
r AS (SELECT run, list_reduce(l, lambda s, x: CASE WHEN s.idle >= 3 THEN s ELSE struct_pack(a := CASE WHEN x.a < s.a - 0.01 THEN x.a ELSE s.a END, b := CASE WHEN x.b < s.b - 0.01 THEN x.b ELSE s.b END,
  idle := CASE WHEN x.a < s.a - 0.01 OR x.b < s.b - 0.01 THEN 0 ELSE s.idle + 1 END, epoch := x.epoch, at_ := CASE WHEN s.at_ < 0 OR x.t < s.t THEN x.epoch ELSE s.at_ END, t := CASE WHEN s.at_ < 0 OR x.t < s.t THEN x.t ELSE s.t END) END) AS r FROM l)
SELECT run, r.epoch AS last_epoch, r.at_ AS best_epoch, round(r.t, 6) AS best FROM r""",
    "threshold_changes": f"WITH c AS ({training.ORACLES['calibrate_thresholds']}), d AS (SELECT label, 0.2::DOUBLE AS old, threshold AS new, round(threshold - 0.2, 6) AS delta FROM c) SELECT * FROM d WHERE abs(delta) > 1e-6 ORDER BY abs(delta) DESC, label LIMIT 8",
    "soft_f1": training._LOGITS + ", c AS (SELECT unnest(range(0, 14)) AS c, unnest(list_transform(ex, lambda v: v / z)) AS p, label % 14 AS y FROM p), s AS (SELECT c, sum(CASE WHEN y = c THEN p ELSE 0 END) AS tp, sum(CASE WHEN y <> c THEN p ELSE 0 END) AS fp, sum(CASE WHEN y = c THEN 1 - p ELSE 0 END) AS fn FROM c WHERE c >= 1 GROUP BY c) SELECT round(1 - avg((2 * tp + 1e-9) / (2 * tp + fp + fn + 1e-9)), 6) AS loss FROM s",
}
