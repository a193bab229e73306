"""LiDAR frames, one row per spin, read from and written to Parquet."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Decoded bytes that a task holds before it hands spins on.
SPIN_BYTES = 16 << 20
SPIN_SCHEMA = "ts_ns bigint, positions array<float>, intensities array<smallint>"


def validate_spins(raw: DataFrame, time_column: str = "t_ns") -> tuple[DataFrame, DataFrame]:
    """Valid spins and a frame of rejected rows.

    A spin needs three position floats per intensity and a time.
    """
    ids = [c for c in raw.columns if c not in (time_column, "positions", "intensities")]
    spins = raw.select(
        *ids,
        F.col(time_column).cast("bigint").alias("ts_ns"),
        F.col("positions").cast("array<float>").alias("positions"),
        F.col("intensities").cast("array<smallint>").alias("intensities"),
    )
    n_pos, n_int = F.coalesce(F.size("positions"), F.lit(-1)), F.coalesce(F.size("intensities"), F.lit(-1))
    error = F.when(F.col("ts_ns").isNull(), "no time").when(
        n_pos != 3 * n_int, F.format_string("%d position floats for %d intensities", n_pos, n_int)
    )
    judged = spins.withColumn("error", error)
    good = judged.filter(F.col("error").isNull()).drop("error")
    return good, judged.filter(F.col("error").isNotNull()).select(*ids, "ts_ns", "error")


def read_spins(spark: SparkSession, paths: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    """Spins of Parquet files with ``t_ns, positions, intensities``.

    ``t_ns`` is BIGINT, or a nanosecond timestamp read as BIGINT by the session setting.
    A spin row is megabytes wide: lower ``spark.sql.parquet.columnarReaderBatchSize`` in
    the session (64, say) so a read batch fits in memory.
    """
    raw = spark.read.parquet(*([paths] if isinstance(paths, str) else paths))
    raw = raw.select(
        F.col("_metadata.file_path").alias("source_id"), F.col("_metadata.row_index").alias("row_idx"),
        "t_ns", "positions", "intensities",
    )
    return validate_spins(raw)


def decode_spins(df: DataFrame, decoder: Callable[[bytes], tuple[Sequence[float], Sequence[int]]], blob: str = "blob") -> tuple[DataFrame, DataFrame]:
    """Spins from compressed blobs, decoded by the caller's function.

    ``df`` has ``spin_start_timestamp`` in microseconds; ``decoder`` maps one blob to
    positions and intensities. A spin is megabytes: a task decodes blob by blob and hands spins
    on whenever it holds SPIN_BYTES of them. ``session.configure`` bounds the batches of blobs it gets.
    """
    ids = [c for c in df.columns if c not in (blob, "spin_start_timestamp")]
    kept = df.select(*ids, F.col("spin_start_timestamp").cast("bigint").alias("spin_start_timestamp"), F.col(blob).alias(blob))
    schema = T.StructType([*kept.select(*ids).schema.fields, *T._parse_datatype_string(SPIN_SCHEMA.replace("ts_ns", "t_ns")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, held, spins = 0, 0, []
            for i, data in enumerate(batch.column(blob)):
                positions, intensities = decoder(data.as_py())
                spins.append((np.asarray(positions, np.float32), np.asarray(intensities, np.int16)))
                held += sum(x.nbytes for x in spins[-1])
                if held >= SPIN_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(spins))
                    t_ns = pc.multiply(part.column("spin_start_timestamp"), 1000)
                    arrays = [_lists([s[k] for s in spins], kind) for k, kind in enumerate((pa.float32(), pa.int16()))]
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ids], t_ns, *arrays], [*ids, "t_ns", "positions", "intensities"])
                    first, held, spins = i + 1, 0, []

    return validate_spins(kept.mapInArrow(run, schema))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, values)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values), kind))


def pack_spins(points: DataFrame, by: Sequence[str] = ("source_id", "channel_id", "ts_ns")) -> DataFrame:
    """One row per spin from points; a spin is one sensor turn, so its size is bounded."""
    by = list(by)
    point = F.struct("point_idx", "x", "y", "z", F.round(F.col("intensity") * 255).cast("smallint").alias("i"))
    packed = points.groupBy(*by).agg(F.sort_array(F.collect_list(point)).alias("p"))
    xyz = F.flatten(F.transform("p", lambda q: F.array(q["x"], q["y"], q["z"]))).cast("array<float>")
    return packed.select(*by, xyz.alias("positions"), F.transform("p", lambda q: q["i"]).alias("intensities"))


def write_spins(points: DataFrame, path: str, by: Sequence[str] = ("source_id", "channel_id", "ts_ns")) -> None:
    """Parquet with ``t_ns, positions, intensities`` and any further key columns."""
    packed = pack_spins(points, by).withColumnRenamed("ts_ns", "t_ns")
    packed.sortWithinPartitions("t_ns").write.mode("errorifexists").parquet(path)
