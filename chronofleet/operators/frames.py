"""Video frame timing: keyframe lookup, coverage, presentation order, pacing.

Frames are ``frames(channel_id, decode_idx, pts_ns, is_key, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofleet.functions.numeric import double_to_long
from chronofleet.plans.histogram import DENSE_BITS
from chronofleet.plans.scan import TARGET_ROWS, OrderedScan

# Smoothness limits and histogram edges of the pacing verdict.
SMOOTH_JITTER_RATIO = 0.25
SMOOTH_P95_RATIO = 1.5
SMOOTH_REPEAT_RATIO = 0.05
SMOOTH_RATE_LOW = 0.9
SMOOTH_RATE_HIGH = 1.1
REPEAT_RATIO = 1.5
RUSHED_RATIO = 0.5
HISTOGRAM_EDGES = (0.25, 0.5, 0.75, 1.25, 1.75, 2.5)
REGULAR_LOW, REGULAR_HIGH = 0.75, 1.25
STARVED_TICK_MS = 12


def keyframe_at(frames: DataFrame, t_ns: int, by: Sequence[str] = ("source_id", "channel_id")) -> DataFrame:
    """Per channel the frame at or before ``t`` and the keyframe to decode from.

    ``frame_idx`` is the last decode index with ``pts <= t`` (-1 if none);
    ``key_idx`` the last keyframe up to it, else the first keyframe (-1 if none).
    """
    reached = F.when(F.col("pts_ns") <= t_ns, F.col("decode_idx"))
    key = F.when(F.col("is_key"), F.col("decode_idx"))
    reached_key = F.when(F.col("is_key") & (F.col("pts_ns") <= t_ns), F.col("decode_idx"))
    none = F.lit(-1).cast("bigint")
    return frames.groupBy(*by).agg(
        F.coalesce(F.max(reached), none).alias("frame_idx"),
        F.coalesce(F.max(reached_key), F.min(key), none).alias("key_idx"),
    )


def frames_from(frames: DataFrame, t_ns: int, by: Sequence[str] = ("source_id", "channel_id")) -> DataFrame:
    """All access units whose pts is at or after that of the keyframe chosen for ``t``."""
    reached = F.col("is_key") & (F.col("pts_ns") <= t_ns)
    place = F.struct("pts_ns", "decode_idx")
    last = F.max(F.when(reached, place))["pts_ns"]
    first = F.min_by(F.when(F.col("is_key"), F.col("pts_ns")), F.when(F.col("is_key"), F.col("decode_idx")))
    start = frames.groupBy(*by).agg(F.coalesce(last, first).alias("_start"))
    return frames.join(start, list(by)).filter(F.col("pts_ns") >= F.col("_start")).drop("_start")


def coverage_ranges(frames: DataFrame, by: Sequence[str] = ("source_id", "channel_id"), target_rows: int | None = None) -> DataFrame:
    """Runs of consecutive decode indices as ``[min pts, max pts + 1)``."""
    ranked = OrderedScan(frames, by, "decode_idx", [], target_rows, F.lit(0), slice_bits=DENSE_BITS).rank("_rank").run()
    return (
        ranked.withColumn("_run", F.col("decode_idx") - F.col("_rank"))
        .groupBy(*by, "_run")
        .agg(
            F.min("decode_idx").alias("first_idx"),
            F.max("decode_idx").alias("last_idx"),
            F.min("pts_ns").alias("start_ns"),
            (F.max("pts_ns") + 1).alias("end_ns"),
        )
        .drop("_run")
    )


def remap_presentation(
    frames: DataFrame, sidecar: DataFrame, by: Sequence[str] = ("source_id", "channel_id"), target_rows: int | None = None
) -> DataFrame:
    """Give decode-ordered frames their sidecar times.

    An ascending sidecar lists times in presentation order: the k-th time belongs to
    the k-th frame by composition time (ties by decode index). A sidecar that is not
    ascending is in decode order already. ``sidecar(by, frame, ts_ns)`` has one row per
    frame.
    """
    by = list(by)
    steps = OrderedScan(sidecar, by, "frame", [], target_rows, F.lit(0)).lag("_prev", F.col("ts_ns")).run()
    falls = F.col("ts_ns") < F.col("_prev.v")
    order = steps.groupBy(*by).agg(F.coalesce(F.max(falls), F.lit(False)).alias("_decode_order"))
    ranked = OrderedScan(frames, by, "composition", ["decode_idx"], target_rows).rank("_rank").run()
    slot = F.when(F.col("_decode_order"), F.col("decode_idx")).otherwise(F.col("_rank") - 1)
    placed = ranked.join(order, by).withColumn("frame", slot).drop("_rank", "_decode_order")
    return placed.join(sidecar.select(*by, "frame", F.col("ts_ns").alias("pts_ns")), [*by, "frame"]).drop("frame")


def bind_frame_times(
    frames: DataFrame, table: DataFrame, by: Sequence[str] = ("source_id", "channel_id"), target_rows: int | None = None
) -> DataFrame:
    """Row i of a time table becomes the time of frame i.

    The result has ``error`` set on every frame of a channel whose counts differ, and
    no time there.
    """
    by = list(by)
    rows = OrderedScan(table.select(*by, "seq", "ts_ns"), by, "seq", [], target_rows, F.lit(0)).rank("_i").run()
    n_rows = table.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
    n_frames = frames.groupBy(*by).agg(F.count(F.lit(1)).alias("_frames"))
    counts = n_frames.join(n_rows, by, "left").withColumn("_rows", F.coalesce("_rows", F.lit(0).cast("bigint")))
    message = F.format_string("%d frames but %d timestamps", "_frames", "_rows")
    counts = counts.withColumn("error", F.when(F.col("_frames") != F.col("_rows"), message))
    times = rows.select(*by, (F.col("_i") - 1).alias("decode_idx"), "ts_ns")
    bound = frames.join(counts.select(*by, "error"), by).join(times, [*by, "decode_idx"], "left")
    return bound.withColumn("ts_ns", F.when(F.col("error").isNull(), F.col("ts_ns")))


def ranked_pick(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    picks: dict[str, tuple[int, int]],
    target_rows: int | None = None,
    tie: str | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Order statistics at 0-based index ``floor(n * a / b)`` (at most n-1), exact.

    ``value`` is an integer, refined by ``tie`` where it is the coarse form of another
    number (which is then what is picked). Equal values are pre-counted, so what is
    ranked is the set of distinct values. ``at_most`` bounds the rows per group, if known: groups
    under the target are sorted as arrays within one aggregate.
    """
    by = list(by)
    keys = [value] if tie is None else [value, tie]
    if at_most is not None and at_most <= (target_rows or TARGET_ROWS):
        held = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*keys))).alias("_held"))
        return held.filter(F.size("_held") > 0).select(*by, *[_pick("_held", *p)[keys[-1]].alias(name) for name, p in picks.items()])
    distinct = df.groupBy(*by, *keys).agg(F.count(F.lit(1)).alias("_m"))
    total = distinct.groupBy(*by).agg(F.sum("_m").alias("_n"))
    scan = OrderedScan(distinct, by, value, keys[1:], target_rows, F.col(tie) if tie else F.lit(0), at_most=at_most)
    joined = scan.running_sum("_upto", F.col("_m")).run().join(total, by)
    aggs = []
    for name, (a, b) in picks.items():
        index = F.least(F.col("_n") - 1, F.floor(F.col("_n") * a / b))
        aggs.append(F.min(F.when(F.col("_upto") > index, F.struct(*keys)))[keys[-1]].alias(name))
    return joined.groupBy(*by).agg(*aggs)


def _pick(held: str, a: int, b: int) -> Column:
    """The element of a sorted array at 0-based index ``floor(n * a / b)``, at most n-1."""
    n = F.size(held)
    return F.get(held, F.least(n - 1, F.floor(n * a / b)).cast("int"))


def paint_steps(trace: DataFrame, by: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Dwell (wall ns) and step (pts ns) between consecutive paints of a trace."""
    return _paint_steps(trace, by, target_rows)[0]


def _paint_steps(trace: DataFrame, by: Sequence[str], target_rows: int | None) -> tuple[DataFrame, int]:
    scan = OrderedScan(trace, by, "wall_ns", ["seq"], target_rows)
    out = scan.lag("_p", F.struct("wall_ns", "pts_ns")).rank("paint_no").run()
    steps = out.filter(F.col("_p").isNotNull()).select(
        *by,
        (F.col("paint_no") - 2).alias("pair_no"),
        (F.col("wall_ns") - F.col("_p.v.wall_ns")).alias("dwell_ns"),
        (F.col("pts_ns") - F.col("_p.v.pts_ns")).alias("step_ns"),
    )
    return steps, scan.largest


def _live_small(pairs: DataFrame, by: list[str], speed: float) -> DataFrame:
    """Pairs with the quantiles of their group, for groups that fit an array: one pass over the pairs.

    The three measures are sorted side by side in the aggregate that gathers a group, and the
    group is unfolded again in the same partition.
    """
    row = ["pair_no", "dwell_ns", "step_ns", "dwell_ms", "intended_ms", "err_ms", "abs_err_ms"]
    sorted_ = [F.array_sort(F.collect_list(c)).alias(f"_s_{c}") for c in ("step_ns", "dwell_ms", "abs_err_ms")]
    group = pairs.groupBy(*by).agg(F.collect_list(F.struct(*row)).alias("_rows"), *sorted_).filter(F.size("_rows") >= 2)
    step = F.abs(_pick("_s_step_ns", 1, 2))
    group = group.select(
        *by, "_rows", (F.size("_rows") + 1).cast("bigint").alias("paints"), step.alias("source_interval_ns"), (step / F.lit(speed) / 1e6).alias("ideal_dwell_ms"),
        _pick("_s_dwell_ms", 1, 2).alias("p50_dwell_ms"), _pick("_s_dwell_ms", 95, 100).alias("p95_dwell_ms"), _pick("_s_abs_err_ms", 95, 100).alias("player_err_p95_ms"),
    )
    return group.select("*", F.inline("_rows")).drop("_rows")


def _live_large(pairs: DataFrame, counts: DataFrame, by: list[str], speed: float, target_rows: int | None, largest: int) -> DataFrame:
    """Pairs with the quantiles of their group, ranked over the distinct values of each measure."""
    # The three distributions are ranked together, one row per measure and pair: an
    # integer of nanoseconds, with the exact error as its tie.
    abs_err = F.col("abs_err_ms")
    measures = F.array(
        F.struct(F.lit("step").alias("_what"), F.col("step_ns").alias("_k"), F.lit(0.0).alias("_v")),
        F.struct(F.lit("dwell").alias("_what"), F.col("dwell_ns").alias("_k"), F.col("dwell_ms").alias("_v")),
        F.struct(F.lit("err").alias("_what"), double_to_long(abs_err * 1e6).alias("_k"), abs_err.alias("_v")),
    )
    measured = pairs.select(*by, F.inline(measures)).withColumn("_x", F.when(F.col("_what") == "step", F.col("_k").cast("double")).otherwise(F.col("_v")))
    quantiles = ranked_pick(measured, [*by, "_what"], "_k", {"_q50": (1, 2), "_q95": (95, 100)}, target_rows, "_x", largest)

    def quantile(what: str, q: str) -> Column:
        return F.max(F.when(F.col("_what") == what, F.col(q)))

    picked = quantiles.groupBy(*by).agg(
        quantile("step", "_q50").cast("bigint").alias("_step"),
        quantile("dwell", "_q50").alias("p50_dwell_ms"),
        quantile("dwell", "_q95").alias("p95_dwell_ms"),
        quantile("err", "_q95").alias("player_err_p95_ms"),
    )
    ideal = F.abs(F.col("_step")) / F.lit(speed) / 1e6
    base = counts.filter(F.col("paints") >= 3).join(picked, by).withColumn("source_interval_ns", F.abs(F.col("_step"))).withColumn("ideal_dwell_ms", ideal)
    return pairs.join(base.drop("_step"), by)


def pacing_summary(trace: DataFrame, by: Sequence[str], speed: float = 1.0, target_rows: int | None = None) -> DataFrame:
    """Frame-pacing statistics of each paint trace ``(by, wall_ns, pts_ns, seq)``.

    Traces with fewer than three paints keep their paint count; the rest is zero.
    """
    by = list(by)
    speed = speed if speed > 0 else 1.0
    steps, largest = _paint_steps(trace, by, target_rows)
    intended = F.col("step_ns") / 1e6 / F.lit(speed)
    pairs = steps.withColumn("dwell_ms", F.col("dwell_ns") / 1e6).withColumn("intended_ms", intended)
    pairs = pairs.withColumn("err_ms", F.col("dwell_ms") - F.col("intended_ms")).withColumn("abs_err_ms", F.abs("err_ms"))
    counts = trace.groupBy(*by).agg(F.count(F.lit(1)).alias("paints"))
    quoted = ["p50_dwell_ms", "p95_dwell_ms", "player_err_p95_ms"]
    if largest <= (target_rows or TARGET_ROWS):
        live = _live_small(pairs, by, speed)
    else:
        live = _live_large(pairs, counts, by, speed, target_rows, largest)
    d, i = F.col("dwell_ms"), F.col("ideal_dwell_ms")
    ratio = d / F.when(i > 0, i)
    repeat, rushed = (i > 0) & (d >= REPEAT_RATIO * i), (i > 0) & (d <= RUSHED_RATIO * i)
    first_half = F.col("pair_no") < F.floor((F.col("paints") - 1) / 2)
    regular = F.col("intended_ms").between(REGULAR_LOW * i, REGULAR_HIGH * i)
    edges = [float("-inf"), *HISTOGRAM_EDGES, float("inf")]
    bins = [F.count_if((ratio >= lo) & (ratio < hi)) for lo, hi in zip(edges, edges[1:])]
    reg_err = F.when(regular, F.col("err_ms"))
    stats = live.groupBy(*by, "paints", "source_interval_ns", "ideal_dwell_ms", *quoted).agg(
        F.max(d).alias("max_dwell_ms"),
        F.min(d).alias("min_dwell_ms"),
        (F.avg("dwell_ns") / 1e6).alias("mean_dwell_ms"),
        F.stddev_pop(d).alias("jitter_ms"),
        F.count_if(repeat).alias("repeats"),
        F.count_if(rushed & ~repeat).alias("rushed"),
        F.count_if(F.col("step_ns") < 0).alias("backward_steps"),
        (F.avg(F.when(first_half, F.col("dwell_ns"))) / 1e6).alias("_first"),
        (F.avg(F.when(~first_half, F.col("dwell_ns"))) / 1e6).alias("_second"),
        F.array(*bins).alias("hist_dwell"),
        F.stddev_pop("intended_ms").alias("source_jitter_ms"),
        F.stddev_pop("err_ms").alias("player_err_std_ms"),
        F.max("abs_err_ms").alias("player_err_max_ms"),
        F.coalesce(F.stddev_pop(reg_err), F.lit(0.0)).alias("player_err_std_regular_ms"),
        F.count(reg_err).alias("regular_pairs"),
    )

    def rate(mean: Column) -> Column:
        return F.when(mean > 0, i / mean).otherwise(0.0)

    stats = stats.withColumn("playback_rate_ratio", rate(F.col("mean_dwell_ms")))
    stats = stats.withColumn("first_half_rate", rate(F.col("_first"))).withColumn("second_half_rate", rate(F.col("_second")))
    smooth = (
        (i > 0)
        & (F.col("backward_steps") == 0)
        & (F.col("jitter_ms") <= SMOOTH_JITTER_RATIO * i)
        & (F.col("p95_dwell_ms") <= SMOOTH_P95_RATIO * i)
        & (F.col("repeats") <= SMOOTH_REPEAT_RATIO * (F.col("paints") - 1))
        & F.col("playback_rate_ratio").between(SMOOTH_RATE_LOW, SMOOTH_RATE_HIGH)
    )
    stats = stats.withColumn("smooth", smooth).drop("_first", "_second", "paints")
    out = counts.join(stats, by, "left").fillna(0).fillna(False, ["smooth"])
    empty = F.array_repeat(F.lit(0).cast("bigint"), len(bins))
    return out.withColumn("hist_dwell", F.coalesce("hist_dwell", empty))


def rolling_trace(trace: DataFrame, by: Sequence[str], size: int, target_rows: int | None = None) -> DataFrame:
    """The most recent ``size`` paints of each trace, the window the summary runs over."""
    by = list(by)
    ranked = OrderedScan(trace, by, "wall_ns", ["seq"], target_rows).rank("_i").run()
    total = trace.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return ranked.join(total, by).filter(F.col("_i") > F.col("_n") - size).drop("_i", "_n")


def tick_health(ticks: DataFrame, by: Sequence[str], target_rows: int | None = None) -> DataFrame:
    """Gaps between clock ticks: count, maximum, p95 and how many starved."""
    by = list(by)
    scan = OrderedScan(ticks, by, "wall_ns", ["seq"], target_rows).lag("_p", F.col("wall_ns"))
    gaps = scan.run().filter(F.col("_p").isNotNull()).withColumn("gap_ms", (F.col("wall_ns") - F.col("_p.v")) / 1e6)
    stats = gaps.groupBy(*by).agg(
        F.count(F.lit(1)).alias("ticks"),
        F.max("gap_ms").alias("tick_gap_max_ms"),
        F.count_if(F.col("gap_ms") > STARVED_TICK_MS).alias("starved_ticks"),
    )
    ranked = gaps.withColumn("_gap_ns", F.col("wall_ns") - F.col("_p.v"))
    p95 = ranked_pick(ranked, by, "_gap_ns", {"_p95": (95, 100)}, target_rows, at_most=scan.largest)
    return stats.join(p95, by).withColumn("tick_gap_p95_ms", F.col("_p95") / 1e6).drop("_p95")
