"""python -m spanloom redact|curate|evaluate|errors|enrich|examples ...: the engine on files."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import annotate, evaluate, report, responses, score, supervise
from .ship import ship
from .sources import positions, records
from .sources import seen as seen_texts


def redact(spark: SparkSession, source: str, target: str, threshold: float) -> None:
    """Rows as they stand in the file, numbered from 0; one without a text is an empty one."""
    rows = positions.arrived(records.read(spark, source)) if source.endswith(".json") else positions.read_numbered(spark, source, records.DOCUMENT)
    docs = rows.select(F.col("_row").alias("row_id"), F.coalesce(records.text_of(rows), F.lit("")).alias("text"))
    records.write_lines(score.infer(docs, "row_id", "text", threshold=threshold), target, "overwrite")


def curate(spark: SparkSession, source: str, target: str) -> None:
    """Every span with its value and, if it can't be used, why."""
    rows = records.read(spark, source)
    spans = rows.select(records.text_of(rows).alias("text"), F.explode_outer(F.coalesce("spans", "items")).alias("s")).filter("s is not null")
    form = annotate.normalised(F.col("s"), F.col("text"))
    out = spans.select("text", form.alias("span"), annotate.malformed(F.col("text"), F.coalesce("s.start", "s.start_position"), F.coalesce("s.end", "s.end_position"), F.coalesce("s.label", "s.entity_type")).alias("malformed"))
    records.write_lines(out, target, "overwrite")


def evaluate_files(spark: SparkSession, predicted: str, gold: str, target: str) -> None:
    """Both files hold doc_id and spans; the result has the counts and rates of every label."""
    schema = f"doc_id string, spans array<{records.SPAN}>"
    sides = [records.read(spark, p, schema).select("doc_id", F.explode("spans").alias("s")).select("doc_id", C.label(F.col("s.label")).alias("label"), "s.start", "s.end") for p in (predicted, gold)]
    records.write_lines(evaluate.per_label(evaluate.matched(*sides, ["doc_id", "label", "start", "end"])), target, "overwrite")


def _sides(spark: SparkSession, predicted: str, gold: str) -> list:
    schema = f"doc_id string, spans array<{records.SPAN}>"
    sides = [records.read(spark, p, schema).select("doc_id", F.explode("spans").alias("s")) for p in (predicted, gold)]
    return [d.select("doc_id", C.label(F.col("s.label")).alias("label"), C.strip(F.col("s.value")).alias("value")).filter("label <> 'NONE' and value is not null") for d in sides]


def errors(spark: SparkSession, predicted: str, gold: str, target: str) -> None:
    """Both files hold doc_id and spans with values: summary.json, report.md and report.html of how they differ."""
    related = evaluate.relationships(*_sides(spark, predicted, gold), "doc_id").cache()
    merged = evaluate.merged_supersets(related, "doc_id")
    sides = evaluate.by_side(merged)
    confusion = evaluate.confusion(related, evaluate.labels(related))
    taxonomy = merged.groupBy("kind", F.coalesce("pred_label", "gold_label").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    records.put(spark, f"{target}/summary.json", json.dumps(report.summary(sides, evaluate.totals(sides), confusion), indent=2, ensure_ascii=False))
    records.put(spark, f"{target}/report.md", report.markdown(taxonomy, confusion))
    records.put(spark, f"{target}/report.html", report.html(taxonomy, confusion))
    related.unpersist()


def enrich(spark: SparkSession, source: str, target: str | None, fields: str) -> None:
    """Spans of the named fields with values anew from their offsets; <target>.counts says how many, and how many had another value."""
    names = spark.range(1).select(C.field_list(F.lit(fields))).first()[0]
    if not names:
        raise SystemExit("no fields named")
    target = target or spark.range(1).select(C.with_values_path(F.lit(source))).first()[0]
    rows = records.read_any(spark, source)
    text = records.text_of(rows)
    if rows.filter(text.isNull()).limit(1).count():
        raise SystemExit("a row has neither text nor full_text")
    alias = lambda s: s.withField("start", F.when(s["start"].isNull() | s["end"].isNull(), s["start_position"]).otherwise(s["start"])).withField("end", F.when(s["start"].isNull() | s["end"].isNull(), s["end_position"]).otherwise(s["end"]))
    made = rows.select(*rows.columns, *(annotate.enriched(text, F.transform(f, alias)).alias(f"_{f}") for f in names))
    records.write_lines(made.withColumns({f: F.col(f"_{f}.spans") for f in names}).select(*rows.columns), target, "overwrite")
    total = lambda part: F.coalesce(F.sum(sum((F.coalesce(F.col(f"_{f}.{part}"), F.lit(0)) for f in names), F.lit(0))), F.lit(0)).alias(part)
    records.write_lines(made.agg(F.count(F.lit(1)).alias("rows"), total("updated"), total("mismatched")), f"{target}.counts", "overwrite")


def examples(spark: SparkSession, source: str, target: str, seen: str | None) -> None:
    """Training examples from models' responses (call, content): parsed, validated, each text once and none of ``seen``, split nine to one; with what was rejected and why."""
    made = responses.examples(records.read_lines(spark, source, "call string, content string"), "call", "content").withColumn("doc_id", F.concat_ws("-", "call", F.format_string("%06d", F.coalesce("idx", F.lit(0)))))
    fine = made.filter("error is null")
    judged = annotate.validated(fine.select("doc_id", "text", "items"), "doc_id").cache()
    broken = made.filter("error is not null").groupBy("call").agg(F.min("error").alias("reason")).select(F.col("call").alias("doc_id"), F.lit("FAIL").alias("status"), "reason")
    records.write_lines(judged.filter("status <> 'OK'").unionByName(broken), f"{target}/rejected", "overwrite")
    good = fine.join(judged.filter("status = 'OK'"), "doc_id", "left_semi").select("doc_id", "text", "items")
    old = records.read_lines(spark, seen).select("text") if seen else spark.createDataFrame([], "text string")
    spans = {"spans": "REAL_PII", "pii_lookalike": "PII_LOOKALIKE"}
    rows = positions.numbered(seen_texts.unseen(good, old), ["doc_id"]).select((F.col("_row") + 1).alias("row_id"), "text", *(annotate.spans_of_category(F.col("text"), F.col("items"), c).alias(k) for k, c in spans.items()))
    rows = rows.cache()
    parts = supervise.split(rows.select("row_id", F.lit("all").alias("group")), "group", "row_id", 9, 10)
    for name in ("train", "valid"):
        records.write_lines(rows.join(parts.filter(F.col("part") == name), "row_id", "left_semi"), f"{target}/{name}", "overwrite")
    rows.unpersist()
    judged.unpersist()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="spanloom")
    commands = parser.add_subparsers(dest="command", required=True)
    paths = {"redact": ("source", "target"), "curate": ("source", "target"), "evaluate": ("predicted", "gold", "target"), "errors": ("predicted", "gold", "target"), "enrich": ("source",), "examples": ("source", "target")}
    for name, of in paths.items():
        sub = commands.add_parser(name)
        for p in of:
            sub.add_argument(p)
        if name == "redact":
            sub.add_argument("--threshold", type=float, default=0.5)
        if name == "enrich":
            sub.add_argument("--target")
            sub.add_argument("--fields", default="spans,items,sensitivity_spans")
        if name == "examples":
            sub.add_argument("--seen")
    given = vars(parser.parse_args(args))
    run = {"redact": redact, "curate": curate, "evaluate": evaluate_files, "errors": errors, "enrich": enrich, "examples": examples}[given.pop("command")]
    run(ship(SparkSession.builder.appName("spanloom").getOrCreate()), **given)


if __name__ == "__main__":
    main()
