"""Series transforms, alignment, segments and summaries on ``samples``."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofleet.functions.geometry import yaw
from chronofleet.functions.numeric import finite_or_null, is_finite, nan
from chronofleet.operators.ranges import KEY
from chronofleet.plans.scan import OrderedScan


# -- pointwise and neighbour transforms ------------------------------------------
def absolute(samples: DataFrame) -> DataFrame:
    return samples.withColumn("value", F.abs("value"))


def scale(samples: DataFrame, mul: float, add: float = 0.0) -> DataFrame:
    return samples.withColumn("value", F.col("value") * F.lit(float(mul)) + F.lit(float(add)))


def transform(samples: DataFrame, spec: DataFrame, target_rows: int | None = None, by: Sequence[str] = KEY) -> DataFrame:
    """Apply ``spec(channel_id, kind, mul, add)``: none, abs, scale or derivative.

    Channels without a spec row pass unchanged. The spec is one row per channel; the
    join strategy is left to the optimizer.
    """
    joined = samples.join(spec.select("channel_id", "kind", "mul", "add"), "channel_id", "left")
    slopes = F.coalesce(F.col("kind") == "derivative", F.lit(False))
    v = F.col("value")
    pointwise = F.when(F.col("kind") == "abs", F.abs(v)).when(
        F.col("kind") == "scale", v * F.coalesce("mul", F.lit(1.0)) + F.coalesce("add", F.lit(0.0))
    )
    direct = joined.filter(~slopes).withColumn("value", pointwise.otherwise(v)).select(*samples.columns)
    # Only the channels that need their neighbour are shuffled.
    return direct.unionByName(derivative(joined.filter(slopes).select(*samples.columns), by, target_rows))


def _slope(ts: str, value: str):
    dt = (F.col(ts) - F.col(f"_p.v.{ts}")) / F.lit(1e9)
    return F.when(dt > 0, (F.col(value) - F.col(f"_p.v.{value}")) / F.when(dt > 0, dt)).otherwise(nan())


def derivative(samples: DataFrame, by: Sequence[str] = KEY, target_rows: int | None = None, histogram: DataFrame | None = None) -> DataFrame:
    """Change per second; NaN on the first sample and where time does not advance.

    ``histogram``, here and elsewhere, is the one stored with the lake that ``samples`` come from.
    """
    rows = OrderedScan(samples, by, target_rows=target_rows, histogram=histogram).lag("_p", F.struct("ts_ns", "value")).run()
    return rows.withColumn("value", _slope("ts_ns", "value")).select(*samples.columns)


def _time_steps():
    """Seconds since the previous and to the next row of a ``_p``/``_n`` scan."""
    return (F.col("ts_ns") - F.col("_p.v.ts_ns")) / F.lit(1e9), (F.col("_n.v.ts_ns") - F.col("ts_ns")) / F.lit(1e9)


def _gradient_of(rise_before: Column, rise_after: Column) -> Column:
    """Slope from the rises to both neighbours: second order inside, one-sided at the ends."""
    hs, hd = _time_steps()
    first, last = F.col("_p").isNull(), F.col("_n").isNull()
    inner = F.try_divide(hs * hs * rise_after + hd * hd * rise_before, hs * hd * (hd + hs))
    slope = (
        F.when(first & last, F.lit(None).cast("double"))
        .when(first, F.try_divide(rise_after, hd))
        .when(last, F.try_divide(rise_before, hs))
        .otherwise(inner)
    )
    return F.coalesce(slope, nan())


def gradient(samples: DataFrame, by: Sequence[str] = KEY, target_rows: int | None = None, histogram: DataFrame | None = None) -> DataFrame:
    """Second-order central difference on uneven time, one-sided at both ends."""
    here = F.struct("ts_ns", "value")
    rows = OrderedScan(samples, by, target_rows=target_rows, histogram=histogram).lag("_p", here).lead("_n", here).run()
    v = F.col("value")
    slope = _gradient_of(v - F.col("_p.v.value"), F.col("_n.v.value") - v)
    return rows.withColumn("value", slope).select(*samples.columns)


def _turns(step: Column) -> Column:
    """Whole turns to add so that an angle step falls within half a turn."""
    turn = 2 * math.pi
    wrapped = F.pmod(step + math.pi, F.lit(turn)) - math.pi
    wrapped = F.when((wrapped == -math.pi) & (step > 0), F.lit(math.pi)).otherwise(wrapped)
    turns = F.when(F.abs(step) < math.pi, 0).otherwise(F.round((wrapped - step) / turn)).try_cast("bigint")
    return F.coalesce(turns, F.lit(0).cast("bigint"))


def unwrap(samples: DataFrame, by: Sequence[str] = KEY, target_rows: int | None = None, histogram: DataFrame | None = None) -> DataFrame:
    """Remove 2*pi jumps from an angle series.

    Each step contributes a whole number of turns; the running total is an integer sum,
    so it does not depend on how the series is split.
    """
    first = OrderedScan(samples, by, target_rows=target_rows, histogram=histogram).lag("_p", F.col("value"))
    rows = first.run(keep=True).withColumn("_turns", _turns(F.col("value") - F.col("_p.v")))
    total = OrderedScan(rows, by, like=first).running_sum("_total", F.col("_turns")).run()
    return total.withColumn("value", F.col("value") + F.col("_total") * (2 * math.pi)).select(*samples.columns)


def ego_signals(poses: DataFrame, by: Sequence[str] = ("source_id",), target_rows: int | None = None) -> DataFrame:
    """Speed, yaw rate (deg/s) and acceleration from poses ``(ts_ns, seq, x, y, qw..qz)``.

    The yaw rate is the gradient of the unwrapped heading. A gradient only needs the
    rises to both neighbours, so each is unwrapped by itself and no running total is kept.
    """
    by = list(by)
    heading = yaw(*[F.col(c) for c in ("qw", "qx", "qy", "qz")])
    base = poses.select(*by, "ts_ns", "seq", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), heading.alias("yaw"))
    here = F.struct("ts_ns", "x", "y", "yaw")
    first = OrderedScan(base, by, target_rows=target_rows).lag("_p", here).lead("_n", here)
    rows = first.run(keep=True)

    def rises(c: str) -> tuple[Column, Column]:
        return F.col(c) - F.col(f"_p.v.{c}"), F.col(f"_n.v.{c}") - F.col(c)

    def short(step: Column) -> Column:
        return step + _turns(step) * (2 * math.pi)

    vx, vy = _gradient_of(*rises("x")), _gradient_of(*rises("y"))
    rate = F.degrees(_gradient_of(*[short(r) for r in rises("yaw")]))
    moving = rows.withColumns({"speed": F.sqrt(vx * vx + vy * vy), "yaw_rate_dps": rate}).drop("_p", "_n", "x", "y", "yaw")
    here = F.struct("ts_ns", "speed")
    rows = OrderedScan(moving, by, like=first).lag("_p", here).lead("_n", here).run()
    accel = _gradient_of(*rises("speed"))
    return rows.select(*by, "ts_ns", "seq", "speed", "yaw_rate_dps", accel.alias("accel"))


# -- alignment -------------------------------------------------------------------
def _check_channels(channels: Sequence[str]) -> list[str]:
    channels = list(channels)
    if not channels:
        raise ValueError("alignment takes at least one channel")
    return channels


def _gathered(picked: DataFrame, channels: list[str], by: list[str], probe: OrderedScan) -> tuple[DataFrame, bool]:
    """``picked`` with all channels of a group in one partition, where no group is hot.

    Windows per channel, aggregates per time and windows per group then share that one exchange.
    """
    cold = bool(by) and probe.size() * len(channels) <= probe.target
    return (picked.repartition(*by), True) if cold else (picked, False)


def align_union(
    samples: DataFrame, channels: Sequence[str], by: Sequence[str] = ("source_id",), target_rows: int | None = None, histogram: DataFrame | None = None
) -> DataFrame:
    """One row per time of any channel; absent and non-finite values are NULL.

    The n-th sample of a channel at one time pairs with the n-th of the others.
    """
    channels = _check_channels(channels)
    by = list(by)
    picked = samples.filter(F.col("channel_id").isin(*channels)).select(*by, "channel_id", "ts_ns", "seq", "value")
    series = [*by, "channel_id"]
    probe = OrderedScan(picked, series, target_rows=target_rows, histogram=histogram)
    picked, _ = _gathered(picked, channels, by, probe)
    first = OrderedScan(picked, series, target_rows=target_rows, sized=probe).rank("_rank").lag("_p", F.col("ts_ns"))
    rows = first.run(keep=True)
    opens = F.col("_p").isNull() | (F.col("_p.v") != F.col("ts_ns"))
    rows = rows.withColumn("_open", F.when(opens, F.col("_rank"))).drop("_p")
    rows = OrderedScan(rows, series, like=first).fill("_first", F.col("_open")).run()
    rows = rows.withColumn("occurrence", F.col("_rank") - F.col("_first"))
    cells = [
        F.max(F.when(F.col("channel_id") == c, finite_or_null(F.col("value")))).alias(c) for c in channels
    ]
    return rows.groupBy(*by, "ts_ns", "occurrence").agg(*cells)


def _wide_last(picked: DataFrame, channels: list[str], by: list[str]) -> DataFrame:
    """One row per time; per channel the last sample of that time as a struct."""
    cells = []
    for i, c in enumerate(channels):
        mine = F.col("channel_id") == c
        held = F.struct(F.col("ts_ns").alias("ts"), F.col("value").alias("v"))
        cells.append(F.max_by(F.when(mine, held), F.when(mine, F.struct("seq"))).alias(f"_c{i}"))
    return picked.groupBy(*by, "ts_ns").agg(*cells)


def _hold(wide: DataFrame, channels: list[str], by: list[str], target_rows: int | None, at_most: int) -> DataFrame:
    # One row per (series, time) is left, so time alone orders it.
    scan = OrderedScan(wide, by, "ts_ns", [], target_rows, F.lit(0), at_most=at_most)
    for i in range(len(channels)):
        scan.fill(f"_h{i}", F.col(f"_c{i}"))
    return scan.run()


def align_hold(
    samples: DataFrame,
    channels: Sequence[str],
    threshold_ns: float | None,
    by: Sequence[str] = ("source_id",),
    target_rows: int | None = None,
    histogram: DataFrame | None = None,
) -> DataFrame:
    """Step-hold alignment: the last sample is held while its age is within the threshold.

    Where a channel pauses for longer, two extra times mark the end of the hold and the
    start of the gap. Without a usable threshold this is :func:`align_union`.
    """
    if threshold_ns is None or not math.isfinite(threshold_ns) or threshold_ns <= 0:
        return align_union(samples, channels, by, target_rows, histogram)
    channels = _check_channels(channels)
    by = list(by)
    threshold = int(threshold_ns)
    step = max(1, round(threshold * 1e-6))
    picked = samples.filter(F.col("channel_id").isin(*channels)).select(*by, "channel_id", "ts_ns", "seq", "value")
    # One count bounds both scans: a sample adds at most two marker rows.
    series = [*by, "channel_id"]
    probe = OrderedScan(picked, series, target_rows=target_rows, histogram=histogram)
    largest = probe.size() * len(channels)
    picked, _ = _gathered(picked, channels, by, probe)
    # Of several samples at one time only the last sees a gap after it.
    scan = OrderedScan(picked, series, target_rows=target_rows, sized=probe)
    gaps = scan.lead("_n", F.col("ts_ns")).run()
    gap = F.col("_n.v") - F.col("ts_ns") > threshold
    held_end = F.col("ts_ns") + threshold
    times = F.when(gap, F.array(F.col("ts_ns"), held_end, held_end + step)).otherwise(F.array("ts_ns"))
    axis = gaps.withColumn("_at", F.explode(times))
    real = F.col("_at") == F.col("ts_ns")
    rows = axis.select(
        *by,
        F.when(real, F.col("channel_id")).alias("channel_id"),
        F.col("_at").alias("ts_ns"),
        "seq",
        "value",
    )
    held = _hold(_wide_last(rows, channels, by), channels, by, target_rows, 3 * largest)
    out = []
    for i, c in enumerate(channels):
        h = F.col(f"_h{i}")
        fresh = F.col("ts_ns") - h["ts"] <= threshold
        out.append(F.when(fresh, finite_or_null(h["v"])).alias(c))
    return held.select(*by, "ts_ns", *out)


def table_model(
    samples: DataFrame,
    channels: Sequence[str],
    by: Sequence[str] = ("source_id",),
    max_rows: int | None = None,
    target_rows: int | None = None,
    histogram: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct time; every cell holds its channel's last value (NaN kept).

    Column ``<channel>`` is the held value, ``<channel>__exact`` tells whether a sample
    falls on that very time. All rows are returned unless ``max_rows`` asks for the first of
    each ``by`` group; ``truncated`` is set where that cut.
    """
    channels = _check_channels(channels)
    by = list(by)
    picked = samples.filter(F.col("channel_id").isin(*channels)).select(*by, "channel_id", "ts_ns", "seq", "value")
    probe = OrderedScan(picked, by, target_rows=target_rows, histogram=histogram)
    if by and probe.size() <= probe.target:
        picked = picked.repartition(*by)  # times are formed and scanned after one exchange
    wide = _wide_last(picked, channels, by)
    scan = OrderedScan(wide, by, "ts_ns", [], target_rows, F.lit(0), sized=probe).rank("_row")
    for i in range(len(channels)):
        scan.fill(f"_h{i}", F.col(f"_c{i}"))
    held = scan.run()
    cells = []
    for i, c in enumerate(channels):
        cells += [F.col(f"_h{i}")["v"].alias(c), F.col(f"_c{i}").isNotNull().alias(f"{c}__exact")]
    if max_rows is None:
        return held.select(*by, "ts_ns", *cells, F.lit(False).alias("truncated"))
    if not by:
        n = wide.select(F.count(F.lit(1)).alias("_rows"))
        counted = held.filter(F.col("_row") <= max_rows).join(F.broadcast(n))  # one row
    else:
        n = wide.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"))
        counted = held.filter(F.col("_row") <= max_rows).join(n, by)
    return counted.select(*by, "ts_ns", *cells, (F.col("_rows") > max_rows).alias("truncated"))


# -- summaries and segments ------------------------------------------------------
def series_stats(samples: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Minimum, maximum and mean over finite values (NaN if none); count of all."""
    v = finite_or_null(F.col("value"))
    return samples.groupBy(*by).agg(
        F.coalesce(F.min(v), nan()).alias("min_value"),
        F.coalesce(F.max(v), nan()).alias("max_value"),
        F.coalesce(F.avg(v), nan()).alias("mean_value"),
        F.count(F.lit(1)).alias("sample_count"),
    )


def compare_sources(stats: DataFrame, left_source: str, right_source: str, tolerance: float = 1e-9) -> DataFrame:
    """Same-named channels of two sources side by side, with an agreement flag."""

    def side(source: str, prefix: str) -> DataFrame:
        mine = stats.filter(F.col("source_id") == source)
        return mine.select("channel_id", *[F.col(c).alias(f"{prefix}_{c}") for c in ("min_value", "max_value", "sample_count")])

    both = side(left_source, "left").join(side(right_source, "right"), "channel_id")
    agree = (
        (F.abs(F.col("left_min_value") - F.col("right_min_value")) <= tolerance)
        & (F.abs(F.col("left_max_value") - F.col("right_max_value")) <= tolerance)
        & (F.col("left_sample_count") == F.col("right_sample_count"))
    )
    return both.withColumn("agrees", agree)


def state_segments(
    samples: DataFrame, range_end_ns: int, by: Sequence[str] = KEY, value: str = "value", target_rows: int | None = None, histogram: DataFrame | None = None
) -> DataFrame:
    """Runs of equal state as ``[start_ns, end_ns)``; a non-finite run is one NULL gap.

    Only rows where the state changes go on to the second scan.
    """
    by = list(by)
    state = finite_or_null(F.col(value).cast("double"))
    rows = samples.select(*by, "ts_ns", "seq", state.alias("state"))
    first = OrderedScan(rows, by, target_rows=target_rows, histogram=histogram).lag("_p", F.col("state"))
    prev = first.run(keep=True)
    changed = F.col("_p").isNull() | ~F.col("state").eqNullSafe(F.col("_p.v"))
    starts = prev.filter(changed).drop("_p")
    ends = OrderedScan(starts, by, like=first).lead("_n", F.col("ts_ns")).run()
    return ends.select(
        *by,
        F.col("ts_ns").alias("start_ns"),
        F.coalesce("_n.v", F.lit(range_end_ns).cast("bigint")).alias("end_ns"),
        F.col("state").alias("value"),
    )


def state_at(segments: DataFrame, t_ns: int, by: Sequence[str] = KEY) -> DataFrame:
    """The segment in force at ``t``: the last that starts at or before it."""
    started = segments.filter(F.col("start_ns") <= t_ns)
    picked = started.groupBy(*by).agg(F.max_by(F.struct("start_ns", "end_ns", "value"), F.struct("start_ns", "end_ns")).alias("s"))
    return picked.select(*by, "s.*")


# -- index pairing and tracks ----------------------------------------------------
def zip_by_index(a: DataFrame, b: DataFrame, by: Sequence[str] = ("source_id",), target_rows: int | None = None) -> DataFrame:
    """The i-th sample of ``a`` with the i-th of ``b``; the shorter length wins."""
    by = list(by)

    def ranked(df: DataFrame, name: str) -> DataFrame:
        rows = OrderedScan(df.select(*by, "ts_ns", "seq", "value"), by, target_rows=target_rows).rank("_i").run()
        cols = [F.col("value").alias(name)] + ([F.col("ts_ns")] if name == "a" else [])
        return rows.select(*by, (F.col("_i") - 1).alias("idx"), *cols)

    return ranked(a, "a").join(ranked(b, "b"), [*by, "idx"])


def gps_track(
    lat: DataFrame,
    lon: DataFrame,
    max_points: int,
    by: Sequence[str] = ("source_id",),
    target_rows: int | None = None,
) -> DataFrame:
    """Strided track of at most about ``max_points`` fixes with finite coordinates.

    The last fix is always kept, unless it repeats the last one kept by the stride.
    """
    by = list(by)
    pairs = zip_by_index(lat, lon, by, target_rows).withColumnRenamed("a", "lat").withColumnRenamed("b", "lon")
    finite = is_finite(F.col("lat")) & is_finite(F.col("lon"))
    n = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_points)).cast("bigint")
    marked = pairs.join(n, by).withColumn("_stride", stride).withColumn("_kept", (F.col("idx") % F.col("_stride") == 0) & finite)
    tail = (F.col("idx") == F.col("_n") - 1) & (F.col("idx") % F.col("_stride") != 0) & finite
    point = F.struct("idx", "lat", "lon")
    last_kept = marked.groupBy(*by).agg(F.max(F.when(F.col("_kept"), point)).alias("_last"))
    rows = marked.filter(F.col("_kept") | tail).join(last_kept, by)
    repeat = (F.col("lat") == F.col("_last.lat")) & (F.col("lon") == F.col("_last.lon"))
    keep = F.col("_kept") | F.col("_last").isNull() | ~repeat
    return rows.filter(keep).select(*by, "idx", "ts_ns", "lat", "lon")
