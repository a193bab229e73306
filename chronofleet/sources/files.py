"""Files as rows of a frame, and how a task opens one."""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# These helpers travel to the workers with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def list_files(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """``path, name, n_bytes`` of files; contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n_bytes"))


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and inner path of a path as Spark spells it."""
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:") else f"file://{path}")


def task_count(spark: SparkSession) -> int:
    """Tasks to deal units of work to by number, which adaptive execution leaves alone."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
