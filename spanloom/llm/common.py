"""Scratch tables in the folder that the whole cluster shares, and small column helpers."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared

#: Frees a write's shuffles when it is done, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs in this process, one in the warehouse that goes when the process ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path.removeprefix("file:"), True)
    return path.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Where scratch() hands over the tables that results still read from, in this thread or task.
_held: ContextVar[list[str] | None] = ContextVar("held", default=None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which callers may delete() themselves before shared.release() does."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    shared.keep(spark, path)
    return path


_count = [0]


def made() -> int:
    """How many scratch tables this process has written."""
    return _count[0]


class Scratch:
    """The tables of one call of an operator, in a folder of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.tables: dict[int, tuple[DataFrame, str]] = {}
        self.kept: list[str] = []

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}-{uuid.uuid4().hex}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` as Parquet and reads it back: the lineage ends there, and lost executors lose none of it."""
        path = self.path(name)
        before = self.spark.conf.get(_CLEANUP, "false")
        self.spark.conf.set(_CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(_CLEANUP, before)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.tables[id(table)] = table, path
        _count[0] += 1
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read again."""
        for table in tables:
            delete(self.spark, self.tables.pop(id(table))[1])

    def keep(self, table: DataFrame | str) -> None:
        """The call's result reads from this table or path, so it stays: held() deletes it when the result is written, else shared.release() or the end of the process."""
        self.kept.append(table if isinstance(table, str) else self.tables.pop(id(table))[1])


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """A Scratch whose tables are deleted at the end, but for those to keep()."""
    made = Scratch(spark)
    try:
        yield made
    except BaseException:
        delete(spark, made.folder)
        raise
    for _, path in made.tables.values():
        delete(spark, path)
    if not made.kept:
        delete(spark, made.folder)
    elif (held := _held.get()) is not None:
        held.append(made.folder)
    else:
        shared.keep(spark, made.folder)


@contextlib.contextmanager
def held(spark: SparkSession) -> Iterator[None]:
    """For callers that write the results of what they call inside: deletes what these read from at the end."""
    token = _held.set([])
    try:
        yield
    finally:
        for path in _held.get():
            delete(spark, path)
        _held.reset(token)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: Column, text: Column, *more: Column) -> list[Column]:
    """k1, k2: 128 bits that say which row this is. Rows that repeat share them, and a null text has those of an empty one, as has a null in ``more``, what else a result depends on; a doc_id that is null or used by different texts does no harm."""
    parts = F.coalesce(text, F.lit("")), doc_id.cast("string"), doc_id.isNull(), *(F.coalesce(c.cast("string"), F.lit("")) for c in more)
    return [F.xxhash64(F.lit(k), *parts).alias(f"k{k}") for k in (1, 2)]


def with_rows(docs: DataFrame, found: DataFrame, name: str, *more: str) -> DataFrame:
    """docs with the column ``name`` of found (k1, k2, name), which has a row for each row_key() with the columns ``more``; null where it has none."""
    taken = {c.lower() for c in docs.columns}
    keys = [next(n for n in (c + "_" * i for i in range(len(taken) + 1)) if n not in taken) for c in ("k1", "k2")]
    own = row_key(F.col("doc_id"), F.col("text").cast("string"), *(F.col(c) for c in more))
    rows = docs.select(*(F.col(f"`{c}`") for c in docs.columns), *(k.alias(n) for k, n in zip(own, keys, strict=True)))
    return rows.join(found.select(F.col("k1").alias(keys[0]), F.col("k2").alias(keys[1]), name), keys, "left").select(*(F.col(f"`{c}`") for c in docs.columns), name)


def in_order(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) in the order of doc_id, nulls first, and rows of one doc_id in that of their texts; a doc_id with very many texts is dealt over tasks, by how these begin."""
    return docs.repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
