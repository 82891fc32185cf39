"""Connected components of a graph of long ids, by alternating stars; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _state(edges: DataFrame) -> tuple:
    """What two rounds' edges have in common only where they are the same: their number and two whole sums of 64-bit hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), *(F.sum(F.xxhash64(F.lit(s), "u", "v").cast("decimal(20,0)")) for s in (1, 2))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours. A node's edges, 16 bytes each, meet in one task, sorted and not held."""
    both = edges.union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least).toDF("u", "v").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (the least id in it) of all nodes of ``edges`` (u, v), the component's own id left out.

    Rows that repeat and edges from a node to itself do no harm; no edges give no rows. The result reads from a table
    in the shared folder.
    """
    with common.scratch(edges.sparkSession) as scratch:
        edges = scratch.table(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        before = _state(edges)
        while True:
            after = scratch.table(_small_star(_large_star(edges)), "edges")
            scratch.drop(edges)
            edges, now = after, _state(after)
            if now == before:
                scratch.keep(edges)
                return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
            before = now
