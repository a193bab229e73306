"""Which kind of source each dropped file is."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofleet.sources.files import list_files, located
from chronofleet.sources.recipe import magic_bytes

__all__ = ["classify_files", "kind_of", "list_files", "read_heads"]

# Suffixes in order of priority, and the bytes of a file that are sniffed.
SIDECAR_SUFFIX = ".mp4.timestamps"
#: Bytes of heads that a task holds before it hands them on; a larger document is handed on alone.
HEAD_BYTES = 8 << 20
SUFFIXES = (
    (".mp4.timestamps", "sidecar"),
    (".mp4", "video"),
    (".mcap", "mcap"),
    (".mf4", "mf4"),
    (".bag", "ros1"),
    (".db3", "ros2db3"),
    (".lidar.parquet", "lidar"),
    (".pcd", "lidar"),
    (".xodr", "map_geometry"),
    (".csv", "tabular"),
    (".parquet", "tabular"),
    (".pq", "tabular"),
)


def read_heads(files: DataFrame, n_bytes: int = 0, recipes: DataFrame | None = None) -> DataFrame:
    """Adds ``head``, read by the executors: a JSON document whole, as its marker may stand anywhere,
    of any other file the first ``n_bytes``, or as many as the magics of ``recipes`` reach."""
    if recipes is not None:
        n_bytes = max(n_bytes, magic_bytes(recipes).first()["n_bytes"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", head binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads, first = [], 0
            for i, path in enumerate(batch.column("path").to_pylist()):
                whole = path.lower().endswith(".json")
                fs, inner = located(path)
                with fs.open_input_stream(inner) as f:
                    heads.append(f.read() if whole else f.read(n_bytes))
                if sum(map(len, heads)) >= HEAD_BYTES or i + 1 == batch.num_rows:
                    part = batch.slice(first, len(heads))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(heads, pa.binary())], names=[*batch.schema.names, "head"])
                    heads, first = [], i + 1

    return files.mapInArrow(run, schema)


def kind_of(name: Column, head: Column, calibration_marker: str, map_key: str = "map") -> Column:
    """Kind by suffix; a ``.json`` file by the marker in its head; else ``unknown``."""
    lower = F.lower(name)
    text = head.cast("string")
    kind = F.when(F.lit(False), "")
    for suffix, label in SUFFIXES:
        kind = kind.when(lower.endswith(suffix), label)
    sniffed = (
        F.when(F.contains(text, F.lit(calibration_marker)), "calibration")
        .when(text.rlike(r'(?i)"openlabel"\s*:'), "openlabel")
        .when(text.rlike(r'(?i)"trajectory"\s*:'), "trajectory")
        .when(text.rlike(rf'(?i)"{map_key}"\s*:'), "map_geometry")
    )
    return kind.when(lower.endswith(".json"), F.coalesce(sniffed, F.lit("unknown"))).otherwise("unknown")


def classify_files(files: DataFrame, calibration_marker: str, map_key: str = "map", by: Sequence[str] = ()) -> DataFrame:
    """``kind`` of each file, the ``sidecar`` of each video and an ``error``.

    ``files(by, path, name, head)``; ``head`` may be NULL except for JSON. A video
    without a sidecar has kind ``video_untimed``; a sidecar without its video is an error.
    """
    by = list(by)
    kinds = files.select(*by, "path", "name", kind_of(F.col("name"), F.col("head"), calibration_marker, map_key).alias("kind"))
    cut = F.expr(f"substring(name, 1, length(name) - {len('.timestamps')})")
    # Pairing is by exact name, so both sides meet in one hash aggregation per name.
    keyed = kinds.withColumn("_video", F.when(F.col("kind") == "sidecar", cut).when(F.col("kind") == "video", F.col("name")))
    media = keyed.filter(F.col("_video").isNotNull())
    pairs = media.groupBy(*by, "_video").agg(
        F.max(F.when(F.col("kind") == "sidecar", F.col("path"))).alias("_side"),
        F.bool_or(F.col("kind") == "video").alias("_has_video"),
    )
    joined = keyed.join(pairs, [*by, "_video"], "left")
    kind = F.when((F.col("kind") == "video") & F.col("_side").isNull(), "video_untimed").otherwise(F.col("kind"))
    orphan = (F.col("kind") == "sidecar") & ~F.col("_has_video")
    message = F.when(orphan, F.concat(F.lit("sidecar of a video that is not here: "), "_video"))
    sidecar = F.when(F.col("kind") == "video", F.col("_side"))
    return joined.select(*by, "path", "name", kind.alias("kind"), sidecar.alias("sidecar"), message.alias("error"))
