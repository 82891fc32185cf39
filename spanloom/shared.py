"""Tables that jobs leave for each other, in the folder that the whole cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of tables that were written and not released, by session.
_written: dict[int, list[str]] = {}


def folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset and Spark runs in this process, one in the warehouse that goes when the process ends."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch-{uuid.uuid4().hex}"
        spark.conf.set("spark.checkpoint.dir", path)
        atexit.register(shutil.rmtree, path.removeprefix("file:"), True)
    return path.rstrip("/")


def keep(spark: SparkSession, path: str) -> None:
    """Notes a path that release() is to delete, which is called at the end of the process too."""
    if id(spark.sparkContext) not in _written:
        _written[id(spark.sparkContext)] = []
        atexit.register(_at_exit, spark)
    _written[id(spark.sparkContext)].append(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that release() deletes."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    keep(spark, path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table, read again: evaluated once, so that what depends on the order or the partitions of rows holds for all that read it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Deletes all tables of new_path() and written(), and those that results of the training-data operators read from. Such results can't be evaluated any more."""
    paths = _written.get(id(spark.sparkContext), [])
    while paths:
        delete(spark, paths.pop())


def _at_exit(spark: SparkSession) -> None:
    # a session that was stopped can't reach its store any more
    with contextlib.suppress(Exception):
        release(spark)
