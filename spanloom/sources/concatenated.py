"""Objects printed one after another, over as many lines as they take, read by byte ranges.

Files are cut at closing braces by Spark's own reader, whose tasks each take a block. What a piece does is a function
of the state before it, which is inside a string or outside: a task gives both outcomes for each of its pieces, from
its block's start. Blocks of a file are then put one after another, which says in what state and depth each began,
and a piece whose brace ends the outermost object ends it; only then do pieces of an object meet.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import shared

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.DOTALL)
#: From inside of a string to its end.
_REST = re.compile(r'(?:[^"\\]|\\.)*"', re.DOTALL)
#: What may stand between objects.
_BETWEEN = r"^[\s,\[\]]*$"
#: Pieces of a block that meet in a task.
PIECES = 4096
_SCHEMA = "path string, block long, size long, k long, piece string, bytes long, in0 boolean, depth0 long, in1 boolean, depth1 long"


def _outside(text: str) -> tuple[bool, int]:
    """Whether text, which begins outside of strings, ends inside of one, and by how much its braces deepen."""
    bare = _STRING.sub("", text)
    at = bare.find('"')
    bare, inside = (bare, False) if at < 0 else (bare[:at], True)
    return inside, bare.count("{") - bare.count("}")


def outcomes(piece: str) -> tuple[tuple[bool, int], tuple[bool, int]]:
    """Of a piece without its closing brace: (inside a string at its end, deeper by), beginning outside and inside of a string."""
    end = _REST.match(piece)
    return _outside(piece), _outside(piece[end.end() :]) if end else (True, 0)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece with the states after it and its brace, counted from its block's start, for both states there."""
    here, k, states = None, 0, [(False, 0), (True, 0)]
    for batch in batches:
        rows = []
        for path, block, size, piece in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "size", "value")), strict=True):
            if here != (path, block):
                here, k, states = (path, block), 0, [(False, 0), (True, 0)]
            both = outcomes(piece)
            after = []
            for inside, depth in states:
                ends, deeper = both[inside]
                after.append((ends, depth + deeper - (not ends)))
            states = after
            rows.append((path, block, size, k, piece, len(piece.encode("utf-8", "surrogatepass")), states[0][0], states[0][1], states[1][0], states[1][1]))
            k += 1
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
        names = [part.split()[0] for part in _SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


def read_objects(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, idx (from 0 in its file) and value (the text) of the objects of files; arrays of objects count as the objects in them.

    ValueError in the job for files that end inside of an object or hold something else between objects. Empty files
    have no objects. The result reads from a table in the shared folder.
    """
    cut = spark.read.option("lineSep", "}").text(path)
    cut = cut.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")
    pieces = shared.written(cut.mapInArrow(_pieces, _SCHEMA), "pieces")

    # blocks of a file, one after another: a row for each block
    last = lambda c: F.max_by(c, "k").alias(c)
    blocks = pieces.groupBy("path", "block").agg(*(last(c) for c in ("in0", "depth0", "in1", "depth1")), F.max("k").alias("last"), F.sum(F.col("bytes") + 1).alias("bytes"), F.max("size").alias("size"))
    listed = blocks.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("block", "in0", "depth0", "in1", "depth1"))).alias("blocks"), F.max("block").alias("final"), F.max_by("last", "block").alias("final_k"), (F.sum("bytes") > F.max("size")).alias("open"))
    nothing = F.array().cast("array<struct<block:bigint,inside:boolean,depth:bigint>>")
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("depth"), nothing.alias("starts"))

    def follow(acc, b):
        starts = F.array_append(acc["starts"], F.struct(b["block"].alias("block"), acc["inside"].alias("inside"), acc["depth"].alias("depth")))
        return F.struct(F.when(acc["inside"], b["in1"]).otherwise(b["in0"]).alias("inside"), (acc["depth"] + F.when(acc["inside"], b["depth1"]).otherwise(b["depth0"])).alias("depth"), starts.alias("starts"))

    starts = listed.select("path", "final", "final_k", "open", F.explode(F.aggregate("blocks", start, follow, lambda acc: acc["starts"])).alias("s"))
    starts = starts.select("path", F.col("s.block").alias("block"), F.col("s.inside").alias("inside"), F.col("s.depth").alias("base"), "final", "final_k", "open")
    # no text is shuffled for these: a row for each block
    known = pieces.join(F.broadcast(starts), ["path", "block"])
    inside, depth = F.when(F.col("inside"), F.col("in1")).otherwise(F.col("in0")), F.col("base") + F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    # what follows the last brace of a file isn't followed by one
    tail = F.col("open") & (F.col("block") == F.col("final")) & (F.col("k") == F.col("final_k"))
    known = known.select("path", "block", F.expr(f"k div {PIECES}").alias("run"), "k", "piece", tail.alias("tail"), (~inside & (depth == 0) & ~tail).alias("ends"))

    # objects that ended before a run of pieces, then before a piece in it; blocks would be too much text for a task
    per = known.groupBy("path", "block", "run").agg(F.count_if("ends").alias("n"))
    done = per.select("path", "block", "run", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block", "run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("done"))
    within = F.coalesce(F.sum(F.col("ends").cast("long")).over(Window.partitionBy("path", "block", "run").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = known.withColumn("within", within).join(done, ["path", "block", "run"]).withColumn("idx", F.col("done") + F.col("within"))
    parts = counted.groupBy("path", "idx").agg(F.array_sort(F.collect_list(F.struct("block", "k", "piece", "tail"))).alias("parts"), F.max("ends").alias("whole"))
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["piece"], F.when(p["tail"], "").otherwise("}"))), "")
    parts = parts.select("path", "idx", text.alias("text"), "whole")
    bad = F.when(F.col("whole"), ~F.substring_index("text", "{", 1).rlike(_BETWEEN)).otherwise(~F.col("text").rlike(_BETWEEN))
    checked = F.when(bad, F.raise_error(F.concat("path", F.lit(": JSON must be objects or arrays of objects")))).otherwise(F.expr("substring(text, locate('{', text))"))
    return parts.select("path", "idx", checked.alias("value"), "whole").filter("value is not null and whole").drop("whole")
