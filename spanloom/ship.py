"""Gives the executors this package, where they can't import it from their own path."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> SparkSession:
    """Once a Spark context: adds the package's sources, some 100 KB, as a file that Spark sends to its executors."""
    context = spark.sparkContext
    if not getattr(context, "_spanloom_shipped", False):
        folder = Path(tempfile.mkdtemp(prefix="spark-"))
        package = Path(__file__).resolve().parent
        copy = folder / "sources" / package.name
        shutil.copytree(package, copy, ignore=shutil.ignore_patterns("__pycache__", "*.pyc"))
        context.addPyFile(shutil.make_archive(str(folder / package.name), "zip", folder / "sources"))
        context._spanloom_shipped = True
    return spark
