"""Stateless operators on a stream of sample files.

A recording is replayed by streaming its files. Range filters, pointwise transforms and
camera projection look at one row at a time, so they take a streaming frame unchanged.
Operators that need neighbours are batch work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def stream_samples(spark: SparkSession, path: str, schema: StructType | str, max_files: int = 1000) -> DataFrame:
    """Sample files of a folder as a stream, in bounded steps."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def append_to_lake(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a transformed stream to the lake once, resuming from ``checkpoint``.

    The folder must be one that driver and executors share and that outlives the session.
    """
    writer = stream.writeStream.format("parquet").partitionBy("source_id").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)
