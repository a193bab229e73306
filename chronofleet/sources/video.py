"""Frame-time sidecars and composition times of recorded video."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.plans.scan import OrderedScan


def parse_sidecar(lines: DataFrame, frame_counts: DataFrame | None = None, by: Sequence[str] = ("source_id", "channel_id"), target_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Frame times of valid sidecars, and one error row per rejected one.

    ``lines(by, seq, value)`` in file order. A line is ``frame<TAB>ts_ns``, the frame is
    the 0-based line number, and there are as many lines as ``frame_counts(by, n_frames)``.
    """
    by = list(by)
    ranked = OrderedScan(lines.select(*by, "seq", "value"), by, "seq", [], target_rows, F.lit(0)).rank("_i").run()
    parts = F.split("value", "\t", -1)
    frame, ts = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    # An unsigned index and a signed 64-bit time.
    frame_no = F.when(frame.rlike(r"^\+?\d+$"), frame.try_cast("bigint"))
    ts_ns = F.when(ts.rlike(r"^[+-]?\d+$"), ts.try_cast("bigint"))
    line_no = F.col("_i") - 1
    reason = (
        F.when(F.col("value") == "", "line holds nothing")
        .when(F.size(parts) < 2, "only one field")
        .when(F.size(parts) > 2, "more than two fields")
        .when(frame_no.isNull(), "frame is not an integer")
        .when(frame_no != line_no, "frame is not the line number")
        .when(ts_ns.isNull(), "timestamp is not an integer")
    )
    rows = ranked.select(*by, line_no.alias("frame"), ts_ns.alias("ts_ns"), reason.alias("reason"))
    first_bad = F.min(F.when(F.col("reason").isNotNull(), F.struct("frame", "reason")))
    files = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), first_bad.alias("_bad"))
    if frame_counts is None:
        judged = files.withColumn("n_frames", F.col("_n"))
    else:
        judged = frame_counts.select(*by, "n_frames").join(files, by, "left").withColumn("_n", F.coalesce("_n", F.lit(0).cast("bigint")))
    text = F.when(F.col("_bad").isNotNull(), F.format_string("line %d: %s", "_bad.frame", "_bad.reason")).when(
        F.col("_n") != F.col("n_frames"), F.format_string("%d frames but %d timestamps", "n_frames", "_n")
    )
    judged = judged.withColumn("error", text)
    good = rows.join(judged.filter(F.col("error").isNull()).select(*by), by, "left_semi")
    return good.select(*by, "frame", "ts_ns"), judged.filter(F.col("error").isNotNull()).select(*by, "error")


def read_sidecar(spark: SparkSession, paths: Sequence[str] | str, frame_counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Sidecar files by path; one line of a text split keeps its place in the file."""
    raw = spark.read.text(paths)
    # A single BIGINT in file order: split offset first, then the position in the split.
    place = F.col("_metadata.file_block_start") * (1 << 20) + F.monotonically_increasing_id() % (1 << 33)
    lines = raw.select(F.col("_metadata.file_path").alias("channel_id"), place.alias("seq"), "value")
    return parse_sidecar(lines, frame_counts, ["channel_id"])


def expand_runs(runs: DataFrame, value: str, by: Sequence[str] = ("source_id", "channel_id"), target_rows: int | None = None) -> DataFrame:
    """Run-length table ``(by, run_idx, sample_count, value)`` as one row per sample.

    Adds ``decode_idx`` and ``total``, the sum of ``value`` over all earlier samples.
    """
    by = list(by)
    scan = OrderedScan(runs, by, "run_idx", [], target_rows, F.lit(0))
    scan.running_sum("_upto", F.col("sample_count").cast("bigint"))
    scan.running_sum("_sum", F.col("sample_count").cast("bigint") * F.col(value))
    rows = scan.run().filter(F.col("sample_count") > 0)
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("sample_count").cast("bigint") - 1)).alias("_k"))
    before = F.col("_sum") - F.col("sample_count") * F.col(value)
    return rows.select(
        *by, (F.col("_upto") - F.col("sample_count") + F.col("_k")).alias("decode_idx"),
        F.col(value), (before + F.col("_k") * F.col(value)).alias("total"),
    )


def composition_times(durations: DataFrame, offsets: DataFrame | None, by: Sequence[str] = ("source_id", "channel_id"), target_rows: int | None = None) -> DataFrame:
    """Composition time of every sample from decode durations and composition offsets.

    ``durations(by, run_idx, sample_count, delta)``, ``offsets(by, run_idx, sample_count,
    offset)``; without offsets the composition time is the decode time.
    """
    by = list(by)
    decode = expand_runs(durations, "delta", by, target_rows).select(*by, "decode_idx", F.col("total").alias("_dts"))
    if offsets is None:
        return decode.withColumnRenamed("_dts", "composition")
    shift = expand_runs(offsets, "offset", by, target_rows).select(*by, "decode_idx", "offset")
    # Sizes are guessed from the runs, whose samples are many times as many: never broadcast them.
    joined = decode.join(shift.hint("merge"), [*by, "decode_idx"], "left")
    return joined.select(*by, "decode_idx", (F.col("_dts") + F.coalesce("offset", F.lit(0))).alias("composition"))
