"""JSON in the shapes that annotation files come in, and back.

Lines go through Spark's own reader, and so do documents printed one after another over many lines, in blocks. A file
that holds one document, or an array of them, is read whole by a task where it is known to be one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import annotate
from . import concatenated

SPAN = "struct<start:bigint,end:bigint,label:string,value:string,category:string,sensitivity:string,note:string>"
ALIASED = "struct<start:bigint,end:bigint,start_position:bigint,end_position:bigint,label:string,entity_type:string,value:string,entity_value:string,category:string,sensitivity:string,note:string>"
DOCUMENT = f"text string, full_text string, spans array<{ALIASED}>, items array<{ALIASED}>, sensitivity_spans array<{ALIASED}>"


def read_lines(spark: SparkSession, path: str, schema: str = DOCUMENT, strict: bool = True) -> DataFrame:
    """A document a line, blank lines left out. strict: a line that isn't JSON fails the job; else its text is in _corrupt_record."""
    reader = spark.read.schema(schema if strict else f"{schema}, _corrupt_record string").option("mode", "FAILFAST" if strict else "PERMISSIVE")
    return reader.json(path)


def read_whole(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """A file with one document or an array of them."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """By the name's ending: .json holds documents whole, whatever else a line each."""
    return (read_whole if path.endswith(".json") else read_lines)(spark, path, schema)


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """text and spans of training files, read by their names' endings: spans in the one form, those without offsets or a label left out. A row without a text, or whose spans aren't a list of objects, fails the job."""
    rows = read(spark, path)
    text = text_of(rows)
    some = F.filter(F.transform(F.coalesce("spans", F.array().cast(f"array<{ALIASED}>")), lambda s: annotate.normalised(s, text)), lambda s: s.isNotNull() & s["label"].isNotNull())
    return rows.select(F.coalesce(text, F.raise_error(F.lit(f"{path}: a row has neither text nor full_text"))).alias("text"), some.alias("spans"))


def read_concatenated(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """path, idx and the fields of objects printed one after another, over as many lines as they take; files are read in blocks, see concatenated.read_objects()."""
    rows = concatenated.read_objects(spark, path)
    return rows.select("path", "idx", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("path", "idx", "r.*")


def read_any(spark: SparkSession, path: str, schema: str = DOCUMENT) -> DataFrame:
    """As read(), but a .json file may also hold a document a line, or several one after another."""
    return read_concatenated(spark, path, schema).drop("path", "idx") if path.endswith(".json") else read_lines(spark, path, schema)


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a pattern names, sorted; FileNotFoundError if there is none."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    paths = sorted(f.getPath().toString() for f in found or [])
    if not paths:
        raise FileNotFoundError(f"no files match {pattern}")
    return paths


def first_existing(spark: SparkSession, paths: list[str | None]) -> str | None:
    """The first path at which something is."""
    for path in filter(None, paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            return path
    return None


def read_matching(spark: SparkSession, pattern: str, schema: str = DOCUMENT) -> DataFrame:
    """Documents a line of all files that a pattern names: text, spans, path, and converted: whether the spans come from items.

    A row without a list of spans has those of its REAL_PII items. FileNotFoundError if no file matches.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(matching(spark, pattern)).withColumn("path", F.col("_metadata.file_path"))
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label")))
    spans = annotate.spans_of(plain(F.col("spans")), F.col("items"))
    return rows.select(F.coalesce("text", F.lit("")).alias("text"), spans.alias("spans"), "path", (F.col("items").isNotNull() & F.col("spans").isNull()).alias("converted"))


SPEC = "name string, base_model string, checkpoint string, encoder_path string, max_span_len int, max_length int"


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    """Models to compare, from an array of objects; ValueError if there is none or one has no name or base_model. encoder: encoder_path or else base_model."""
    specs = read_whole(spark, path, SPEC)
    missing = specs.agg(F.count(F.lit(1)), F.count_if(F.col("name").isNull() | F.col("base_model").isNull())).first()
    if not missing[0] or missing[1]:
        raise ValueError(f"{path}: needs objects with name and base_model")
    return specs.withColumn("encoder", F.coalesce("encoder_path", "base_model"))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """df in an order that the digests of ``seed`` and ``key`` give."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key))), key)


def text_of(df: DataFrame) -> Column:
    """The text, whichever name it has."""
    return F.coalesce(*(F.col(c) for c in ("text", "full_text") if c in df.columns))


def write_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_pretty(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Objects over several lines, as read_concatenated() takes them."""
    df.select(F.to_json(F.struct(*df.columns), {"pretty": "true"}).alias("value")).write.mode(mode).text(path)


def write_report(row: DataFrame, path: str) -> None:
    """A frame of one row as one object over several lines."""
    write_pretty(row.coalesce(1), path)


def put(spark: SparkSession, path: str, text: str) -> None:
    """A small text, such as a rendered report, as one file in whatever store the path is in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_review(sections: DataFrame, path: str, order: str, section: str) -> None:
    """Sections of text, in order, a blank line between them; files are parts of the whole in their names' order."""
    sections.orderBy(order).select(F.concat(section, F.lit("\n")).alias("value")).write.mode("overwrite").text(path)
