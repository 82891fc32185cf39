"""Models' responses as tables: text around JSON taken off, examples parsed, usage under either naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import annotate

RESPONSE = "examples array<struct<annotated_text:string,text:string,items:array<struct<start:bigint,end:bigint,category:string,label:string,value:string>>>>"


def bare_json(content: Column) -> Column:
    """Without white space and the fence of a code block around it."""
    return C.strip(F.regexp_replace(F.regexp_replace(C.strip(content), r"^```(?:json)?\s*", ""), r"\s*```$", ""))


def first_object(content: Column) -> Column:
    """The first run of balanced braces, which strings' braces count in; the content itself without one."""
    marks = F.split(F.regexp_replace(content, r"[{}]", "\x01$0"), "\x01")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("depth"), F.lit(False).alias("done"))

    def step(acc: Column, part: Column) -> Column:
        opens, closes = part.startswith("{"), part.startswith("}")
        depth = F.when(opens, acc["depth"] + 1).when(closes & (acc["depth"] > 0), acc["depth"] - 1).otherwise(acc["depth"])
        ends = closes & (acc["depth"] == 1)
        grown = F.when(ends, F.concat(acc["out"], F.lit("}"))).when((depth > 0) | (acc["depth"] > 0), F.concat(acc["out"], part)).otherwise(acc["out"])
        return F.when(acc["done"], acc).otherwise(F.struct(grown.alias("out"), depth.alias("depth"), ends.alias("done")))

    found = F.aggregate(marks, start, step)
    return F.when(found["done"], found["out"]).otherwise(content)


def examples(responses: DataFrame, key: str, content: str) -> DataFrame:
    """key, idx, text, items, error of the examples in responses; an annotated text is parsed, else text and items are as given.

    One bad example spoils its response: error is then that of the first of them, in every row. A response that isn't JSON has one row with an error.
    """
    parsed = responses.select(key, F.from_json(first_object(bare_json(F.col(content))), RESPONSE).alias("r"))
    rows = parsed.select(key, F.posexplode_outer("r.examples").alias("idx", "e")).withColumn("p", annotate.parsed(F.col("e.annotated_text")))
    marked = F.col("e.annotated_text").isNotNull()
    items = F.when(marked, F.transform("p.items", lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["category"].alias("category"), i["label"].alias("label"), i["value"].alias("value")))).otherwise(
        F.transform("e.items", lambda i: F.struct(i["start"].alias("start"), i["end"].alias("end"), i["category"].alias("category"), i["label"].alias("label"), F.coalesce(i["value"], C.slice_text(F.col("e.text"), i["start"], i["end"])).alias("value")))
    )
    fault = F.when(F.col("e").isNull(), "no examples").when(marked, F.col("p.error")).when(F.col("e.text").isNull() | F.col("e.items").isNull(), "neither annotated_text nor text and items")
    rows = rows.select(key, "idx", F.when(marked, F.col("p.text")).otherwise(F.col("e.text")).alias("text"), items.alias("items"), fault.alias("fault"))
    first = rows.groupBy(key).agg(F.min_by("fault", F.when(F.col("fault").isNotNull(), F.coalesce("idx", F.lit(-1)))).alias("error"))
    return rows.drop("fault").join(first, key)


def usage(raw: Column) -> Column:
    """struct(input_tokens, cached_tokens, output_tokens) of a usage object in either naming; what is missing or no number is 0."""
    number = lambda path: F.coalesce(F.get_json_object(raw, path).try_cast("bigint"), F.lit(0))
    either = lambda a, b: F.coalesce(F.nullif(number(a), F.lit(0)), number(b))
    given = either("$.prompt_tokens", "$.input_tokens")
    cached = either("$.prompt_tokens_details.cached_tokens", "$.input_tokens_details.cached_tokens")
    return F.struct(given.alias("input_tokens"), F.least(cached, given).alias("cached_tokens"), either("$.completion_tokens", "$.output_tokens").alias("output_tokens"))
