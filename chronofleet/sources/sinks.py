"""Writers: CSV, JSON rows, catalog JSON, sidecar text and the partitioned sample lake."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofleet.plans.histogram import time_histogram
from chronofleet.plans.scan import OrderedScan

HISTOGRAM = "_histogram"


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, integers for ns, empty cells for NULL, doubled quotes."""
    flat = df.select(*[_csv_cell(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])
    (
        flat.write.mode("errorifexists")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("nullValue", "")
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def _csv_cell(c: Column, t: T.DataType) -> Column:
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c


def to_json_columns(df: DataFrame) -> DataFrame:
    """One JSON object per row in ``json``; 64-bit integers and times are strings.

    Non-finite floats become null, since JSON has no form for them.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.LongType, T.TimestampType, T.TimestampNTZType, T.DecimalType)):
            c = c.cast("string")
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c.cast("double"))
        out.append(c.alias(f.name))
    return df.select(F.to_json(F.struct(*out), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    to_json_columns(df).write.mode("errorifexists").text(path)


def catalog_json(catalog: DataFrame, id_col: str = "channel_id") -> DataFrame:
    """One JSON object per channel: id, name, kind, dtype, unit, count and range."""
    span = F.struct(F.col("start_ns").cast("string").alias("startNs"), F.col("end_ns").cast("string").alias("endNs"))
    name = F.col("name") if "name" in catalog.columns else F.col(id_col)
    obj = F.struct(
        F.col(id_col).alias("id"), name.alias("name"), "kind", "dtype", "unit",
        F.col("sample_count").alias("sampleCount"), span.alias("timeRange"),
    )
    keys = [c for c in ("source_id", id_col) if c in catalog.columns]
    return catalog.select(*keys, F.to_json(obj, {"ignoreNullFields": "false"}).alias("json"))


def sidecar_lines(frames: DataFrame, by: Sequence[str] = ("source_id", "channel_id"), target_rows: int | None = None) -> DataFrame:
    """``line_no`` and the text ``index<TAB>ns`` of each frame in decode order."""
    ranked = OrderedScan(frames, by, "decode_idx", [], target_rows, F.lit(0)).rank("_i").run()
    line = F.col("_i") - 1
    return ranked.select(*by, line.alias("line_no"), F.concat_ws("\t", line.cast("string"), F.col("ts_ns").cast("string")).alias("line"))


def write_sidecar(frames: DataFrame, path: str, by: Sequence[str] = ("source_id", "channel_id")) -> None:
    """One folder per channel; part files follow the line order."""
    lines = sidecar_lines(frames, by).repartitionByRange(*by, "line_no").sortWithinPartitions(*by, "line_no")
    lines.select(*by, "line").write.mode("errorifexists").partitionBy(*by).text(path)


def write_samples(samples: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet by source, sorted by (channel, time) so row-group statistics prune scans.

    The range partitioning samples the data first, so a hot channel or source is spread
    over several files. The time histogram of the written rows is stored beside them, where
    readers of Parquet don't look: ordered scans and last samples are planned from it.
    """
    keys = ["source_id", "channel_id", "ts_ns", *(["seq"] if "seq" in samples.columns else [])]
    ranged = samples.repartitionByRange(partitions, *keys) if partitions else samples.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("errorifexists").partitionBy("source_id").parquet(path)
    written = read_samples(samples.sparkSession, path, samples.schema)
    time_histogram(written, ["source_id", "channel_id"]).write.mode("errorifexists").parquet(f"{path}/{HISTOGRAM}")


def read_samples(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The lake; with its ``schema`` no file is opened to plan a query, and source ids keep their type."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Rows per series and time slice of the lake, as the ``histogram`` argument of operators takes them."""
    return spark.read.parquet(f"{path}/{HISTOGRAM}")
