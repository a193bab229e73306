"""Telemetry-shaped views of the driver tables, in Spark and as DuckDB SQL.

``events`` plays the samples (channel = event type, source = user modulo 4), with NaN,
infinite values and repeated times injected by ``event_id``. ``embeddings`` plays the
LiDAR spins (21 points each).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.functions.numeric import finite_or_null
from chronofleet.session import configure

CHANNELS = ["click", "error", "purchase", "signup", "view"]
SIX_HOURS = 21_600_000_000_000
DAY = 86_400_000_000_000
T0 = 1_704_067_200_000_000_000  # 2024-01-01T00:00:00Z
# Scaled-down split target, so that small test tables exercise the split plans too.
TARGET = 2_000


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``; a temporary one where it is unset, on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="chronofleet-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def ns_of(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp")) * 1000


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ns = ns_of(F.col("ts"))
    i = F.col("event_id")
    inf = F.when(i % 2 == 0, float("inf")).otherwise(float("-inf"))
    return e.select(
        F.concat(F.lit("log-"), (F.col("user_id") % 4).cast("string")).alias("source_id"),
        F.col("event_type").alias("channel_id"),
        F.when(i % 53 == 0, ns - ns % SIX_HOURS).otherwise(ns).alias("ts_ns"),
        i.alias("seq"),
        F.when(i % 97 == 0, float("nan")).when(i % 101 == 0, inf).otherwise(F.col("value")).alias("value"),
    )


TEL = f"""tel AS (
  SELECT 'log-' || (user_id % 4) AS source_id, event_type AS channel_id,
         CASE WHEN event_id % 53 = 0 THEN epoch_us(ts) * 1000 - (epoch_us(ts) * 1000) % {SIX_HOURS}
              ELSE epoch_us(ts) * 1000 END AS ts_ns,
         event_id AS seq,
         CASE WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE
              WHEN event_id % 101 = 0 AND event_id % 2 = 0 THEN 'inf'::DOUBLE
              WHEN event_id % 101 = 0 THEN '-inf'::DOUBLE
              ELSE value END AS value
  FROM events)"""

FINITE = "CASE WHEN isfinite({0}) THEN {0} END"


def spins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    xyz = F.transform(F.slice("embedding", 1, 63), lambda v: (v.cast("double") * 100.0).cast("float"))
    shade = F.transform(F.slice("embedding", 1, 21), lambda v: F.floor(F.abs(v.cast("double")) * 1000.0).cast("smallint") % F.lit(256).cast("smallint"))
    return e.select(
        F.concat(F.lit("log-"), (F.col("vec_id") % 4).cast("string")).alias("source_id"),
        F.concat(F.lit("lidar-"), F.col("label").cast("string")).alias("channel_id"),
        (F.lit(T0) + F.col("vec_id") * 100_000_000).alias("ts_ns"),
        xyz.alias("positions"),
        shade.alias("intensities"),
    )


PTS = f"""pts AS (
  SELECT 'log-' || (vec_id % 4) AS source_id, 'lidar-' || label AS channel_id,
         {T0} + vec_id * 100000000 AS ts_ns, i AS point_idx,
         (embedding[3*i+1]::DOUBLE * 100.0)::FLOAT AS x,
         (embedding[3*i+2]::DOUBLE * 100.0)::FLOAT AS y,
         (embedding[3*i+3]::DOUBLE * 100.0)::FLOAT AS z,
         ((floor(abs(embedding[i+1]::DOUBLE) * 1000.0)::INT % 256) / 255.0)::FLOAT AS intensity
  FROM embeddings, (SELECT range::INT AS i FROM range(21)) r)"""


def r6(c: str | Column) -> Column:
    """Six-place rounding with NaN and infinity as NULL, for value comparison."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(finite_or_null(col.cast("double")), 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def sql6(expr: str) -> str:
    return f"round(CASE WHEN isfinite(({expr})::DOUBLE) THEN ({expr})::DOUBLE END, 6)"
