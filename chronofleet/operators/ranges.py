"""Time-range and as-of operators on ``samples(source_id, channel_id, ts_ns, seq, ...)``.

Windows are half-open ``[start, end)``. Results carry no global sort: order at the
sink with ``orderBy("ts_ns", "seq")`` or ``sortWithinPartitions``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofleet.plans.histogram import SLICE_BITS, merged
from chronofleet.plans.interval_join import interval_join
from chronofleet.plans.scan import TIE_BITS, OrderedScan, fixed_width, order_prefix

KEY = ("source_id", "channel_id")
FIXED_CLOCK_KINDS = ("video", "point_cloud", "bounding_box", "trajectory", "calibration", "map_geometry")


_WHOLE_NUMBER = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
#: Times of one era differ by less than 2 ** ERA_BITS, so (time, tie) is one exact decimal.
ERA_BITS = 61


def _last_row(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The greatest row per key by ``order``, with map-side partial aggregation.

    Whole-number orders and values of fixed width are hash aggregated: (time, tie) becomes
    one decimal within an era of 73 years, and the few eras of a key are compared after. Only rows
    that carry strings, arrays or structs are sorted by key.
    """
    rest = [c for c in df.columns if c not in by]
    ts, *tie = order
    kinds = {c: df.schema[c].dataType for c in rest}
    plain = all(fixed_width(t) is not None and not isinstance(t, T.StructType) for t in kinds.values())
    if plain and len(tie) == 1 and all(isinstance(kinds[c], _WHOLE_NUMBER) for c in order):
        era = F.shiftright(F.col(ts).cast("bigint"), ERA_BITS)
        inside = F.col(ts).cast("bigint") - F.shiftleft(era, ERA_BITS)
        place = inside.cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)") + F.coalesce(F.col(tie[0]).cast("bigint"), F.lit(-(1 << 63))).cast("decimal(19,0)")
        keyed = df.filter(F.col(ts).isNotNull()).withColumns({"_era": era, "_place": place.cast("decimal(38,0)")})
        df_ = keyed.groupBy(*by, "_era").agg(*[F.max_by(c, "_place").alias(c) for c in rest])
        picked = df_.groupBy(*by).agg(F.max_by(F.struct(*rest), "_era").alias("_r"))
    else:
        picked = df.groupBy(*by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*by, "_r.*").select(*df.columns)


def _near(samples: DataFrame, t_ns: int, by: Sequence[str], histogram: DataFrame) -> DataFrame:
    """Rows of each series' last slice that begins at or before ``t_ns``, found in the histogram.

    Series are read in up to three groups by how far back they end, so that the scan of those that
    are up to date gets a late lower bound and prunes files and row groups.
    """
    last = F.max(F.when(F.col("lo") <= t_ns, F.col("slice")))
    ends = merged(histogram, by).groupBy(*by).agg(last.alias("_slice")).filter(F.col("_slice").isNotNull())
    age = F.lit(t_ns >> SLICE_BITS) - F.col("_slice")
    out = None
    bounds = [(0, 1 << 6), (1 << 6, 1 << 12), (1 << 12, None)]  # about an hour, three days
    for low, high in bounds:
        some = ends.filter((age >= low) & (age < high) if high is not None else age >= low)
        rows = samples.filter(F.col("ts_ns") <= t_ns)
        if high is not None:
            rows = rows.filter(F.col("ts_ns") >= ((t_ns >> SLICE_BITS) - high) << SLICE_BITS)
        some = some.select(*[F.col(c).alias(f"_k_{c}") for c in by], "_slice")
        cond = F.shiftright("ts_ns", SLICE_BITS) == F.col("_slice")
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        part = rows.join(some, cond).select(*samples.columns)
        out = part if out is None else out.unionByName(part)
    return out


def fetch_range(
    samples: DataFrame,
    channels: Sequence[str] | None,
    start_ns: int,
    end_ns: int,
    include_prev: bool = False,
    by: Sequence[str] = KEY,
    histogram: DataFrame | None = None,
) -> DataFrame:
    """Samples in ``[start, end)``; optionally the last one before ``start`` per series.

    With the histogram of the lake, only the slice that holds the last one is read of each series.
    """
    if channels is not None:
        samples = samples.filter(F.col("channel_id").isin(*channels))
        histogram = None if histogram is None else histogram.filter(F.col("channel_id").isin(*channels))
    body = samples.filter((F.col("ts_ns") >= start_ns) & (F.col("ts_ns") < end_ns))
    if not include_prev:
        return body
    return body.unionByName(sample_at(samples, start_ns - 1, by, histogram))


def fetch_ranges(samples: DataFrame, windows: DataFrame, by: Sequence[str] = ("source_id", "channel_id"), closed: bool = False) -> DataFrame:
    """Batch form: every window row joined to its samples (``start_ns``/``end_ns``)."""
    return interval_join(samples, windows, by, closed=closed)


def slice_events(samples: DataFrame, events: DataFrame, by: Sequence[str] = ("source_id",)) -> DataFrame:
    """Samples inside ``[ns - before_ns, ns + after_ns]`` of each event."""
    windows = events.withColumn("start_ns", F.col("ns") - F.col("before_ns")).withColumn("end_ns", F.col("ns") + F.col("after_ns"))
    return interval_join(samples, windows, by, closed=True)


def sample_at(samples: DataFrame, t_ns: int, by: Sequence[str] = KEY, histogram: DataFrame | None = None) -> DataFrame:
    """Last sample with ``ts <= t`` per series; no raw row is shuffled.

    With the histogram of the lake only the last slice of each series is read. It must tell of
    all rows that ``samples`` hold; a filter on whole series may have been applied to either.
    """
    if histogram is not None:
        samples = _near(samples, t_ns, by, histogram)
    return _last_row(samples.filter(F.col("ts_ns") <= t_ns), by, ("ts_ns", "seq"))


def snapshot_at(
    t_ns: int,
    scalars: DataFrame | None = None,
    enums: DataFrame | None = None,
    vectors: DataFrame | None = None,
    spins: DataFrame | None = None,
    frames: DataFrame | None = None,
    by: Sequence[str] = KEY,
) -> DataFrame:
    """Full channel inventory with what is active at ``t``.

    One conditional aggregation per table yields both the inventory and the held
    sample, so a channel that has nothing yet is a row with NULLs. Scalars and enums
    carry ``held_value``, vectors ``held_vector``, clouds and video only the time of
    the active spin or frame.
    """
    parts = []
    for kind, df, ts, tie, value, vector in _shapes(scalars, enums, vectors, spins, frames):
        order = F.when(F.col(ts) <= t_ns, F.struct(ts, tie))
        held = F.struct(F.col(ts).alias("ts"), value.alias("value"), vector.alias("vector"))
        one = df.groupBy(*by).agg(F.max_by(held, order).alias("h"), F.count(F.lit(1)).alias("sample_count"))
        parts.append(
            one.select(
                *by,
                F.lit(kind).alias("kind"),
                "sample_count",
                F.col("h.ts").alias("held_ts_ns"),
                F.col("h.value").alias("held_value"),
                F.col("h.vector").alias("held_vector"),
            )
        )
    return _union(parts)


def _shapes(scalars, enums, vectors, spins, frames):
    """Per given table: kind, frame, names of time and tie, value and vector that it holds."""
    no_value, no_vector = F.lit(None).cast("double"), F.lit(None).cast("array<double>")
    tables = (
        ("scalar", scalars, "ts_ns", lambda: (F.col("value").cast("double"), no_vector)),
        ("enum", enums, "ts_ns", lambda: (F.col("code").cast("double"), no_vector)),
        ("vector", vectors, "ts_ns", lambda: (no_value, F.col("value"))),
        ("point_cloud", spins, "ts_ns", lambda: (no_value, no_vector)),
        ("video", frames, "pts_ns", lambda: (no_value, no_vector)),
    )
    for kind, df, ts, picks in tables:
        if df is not None:
            tie = "seq" if "seq" in df.columns else "decode_idx" if "decode_idx" in df.columns else ts
            yield (kind, df, ts, tie, *picks())


def _union(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("a snapshot needs at least one table")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def snapshot_many(
    times: DataFrame,
    scalars: DataFrame | None = None,
    enums: DataFrame | None = None,
    vectors: DataFrame | None = None,
    spins: DataFrame | None = None,
    frames: DataFrame | None = None,
    by: Sequence[str] = KEY,
    target_rows: int | None = None,
) -> DataFrame:
    """:func:`snapshot_at` for every row of ``times(source_id, t_ns, ...)``, at the cost of one scan.

    All tables are stacked as (series, kind, time, tie, value, vector) and merged once with the
    wanted times of each series: the inventory of a source times its rows of ``times`` are the
    rows of the result, and nothing else is multiplied. Columns of ``times`` are kept; a row
    of ``times`` whose source has no channel gives none. ``by`` begins with ``source_id``.
    """
    by = list(by)
    parts, counts = [], []
    for kind, df, ts, tie, value, vector in _shapes(scalars, enums, vectors, spins, frames):
        one = df.select(*by, F.lit(kind).alias("kind"), F.col(ts).alias("t_ns"), F.col(tie).cast("bigint").alias("_tie"), value.alias("value"), vector.alias("vector"))
        parts.append(one)
        counts.append(one.groupBy(*by, "kind").agg(F.count(F.lit(1)).alias("sample_count")))
    series = [*by, "kind"]
    wanted = times.join(_union(counts), "source_id")
    held = asof_join(wanted, _union(parts), series, "t_ns", ["value", "vector"], right_tie="_tie", prefix="held_", target_rows=target_rows)
    return held.withColumnsRenamed({"held_t_ns": "held_ts_ns"})


def _hashable(t: T.DataType) -> bool:
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    return not isinstance(t, (T.MapType, T.VariantType))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str],
    ts: str = "ts_ns",
    values: Sequence[str] = ("value",),
    tolerance_ns: int | None = None,
    right_tie: str = "seq",
    prefix: str = "right_",
    target_rows: int | None = None,
    at_most: int | None = None,
) -> DataFrame:
    """Each left row with the latest right row at or before it, NULLs when there is none.

    Among right rows of one time the last by ``right_tie`` wins. ``tolerance_ns`` drops
    matches older than that. Both sides are stacked and scanned once per series in time
    order, so the cost is one shuffle and sort whatever the match density.

    Values of fixed width travel with the scan. Where a value is a string, array or struct, the scan
    only finds time and tie of the match, and the row is fetched by that key afterwards: no
    payload is sorted, carried across cells or broadcast.
    """
    by = list(by)
    wide = any(fixed_width(right.schema[v].dataType) is None for v in values)
    join = _asof_fetched if wide else _asof_scanned
    return join(left, right, by, ts, values, tolerance_ns, right_tie, prefix, target_rows, at_most)


def _asof_scanned(left, right, by, ts, values, tolerance_ns, right_tie, prefix, target_rows, at_most) -> DataFrame:
    """The as-of join whose values travel with the scan."""
    tie_type = right.schema[right_tie].dataType
    own = [c for c in left.columns if c not in by and c != ts]
    payload = F.struct(F.col(ts).alias("_ts"), *values)
    matched_type = right.select(payload.alias("p")).schema["p"].dataType
    # Right rows sort before left rows of the same time; left rows of one time are
    # interchangeable, so a hash spreads them when a single time is hot.
    lefts = left.select(
        *by, ts, *own,
        F.lit(1).alias("_side"),
        F.pmod(F.xxhash64(*[f.name for f in left.schema if _hashable(f.dataType)]), F.lit(4096)).alias("_salt"),
        F.lit(None).cast(tie_type).alias("_tie_key"),
        F.lit(None).cast(matched_type).alias("_match"),
    )
    rights = right.select(
        *by, ts, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in own],
        F.lit(0).alias("_side"),
        F.lit(0).cast("bigint").alias("_salt"),
        F.col(right_tie).alias("_tie_key"),
        payload.alias("_match"),
    )
    stacked = lefts.unionByName(rights)
    coarse = order_prefix([F.col("_tie_key")], [tie_type], TIE_BITS)[0]
    cell = F.struct("_side", "_salt", coarse.alias("_coarse"))
    scan = OrderedScan(stacked, by, ts, ["_side", "_salt", "_tie_key"], target_rows, cell, at_most=at_most)
    out = scan.fill("_held", F.col("_match")).run().filter(F.col("_side") == 1)
    held = F.col("_held")
    if tolerance_ns is not None:
        held = F.when(F.col(ts) - held["_ts"] <= tolerance_ns, held)
    return out.select(
        *by, ts, *own,
        held["_ts"].alias(f"{prefix}{ts}"),
        *[held[v].alias(f"{prefix}{v}") for v in values],
    )


def _asof_fetched(left, right, by, ts, values, tolerance_ns, right_tie, prefix, target_rows, at_most) -> DataFrame:
    """The as-of join that finds the key of the match first and its row by an equi-join after."""
    keys = right.select(*by, ts, F.col(right_tie).alias("_t"), F.lit(True).alias("_found"))
    found = _asof_scanned(left, keys, by, ts, ["_t", "_found"], tolerance_ns, "_t", "_k_", target_rows, at_most)
    at = f"_k_{ts}"
    rows = right.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col(ts).alias(f"_r_{ts}"), F.col(right_tie).alias("_r_tie"), *[F.col(v).alias(f"{prefix}{v}") for v in values])
    rows = rows.dropDuplicates([*[f"_r_{c}" for c in by], f"_r_{ts}", "_r_tie"])
    cond = F.col("_k__found") & (F.col(at) == F.col(f"_r_{ts}")) & F.col("_k__t").eqNullSafe(F.col("_r_tie"))
    for c in by:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    out = found.join(rows, cond, "left")
    own = [c for c in left.columns if c not in by and c != ts]
    return out.select(*by, ts, *own, F.col(at).alias(f"{prefix}{ts}"), *[f"{prefix}{v}" for v in values])


def apply_offsets(samples: DataFrame, sources: DataFrame) -> DataFrame:
    """Shift every sample by its source's ``time_offset_ns``; exempt kinds stay put.

    ``sources(source_id, kind, time_offset_ns)`` may be any size; the join strategy is
    left to the optimizer.
    """
    shifts = _shifts(sources)
    return (
        samples.join(shifts, "source_id", "left")
        .withColumn("ts_ns", F.col("ts_ns") + F.coalesce("_shift", F.lit(0).cast("bigint")))
        .drop("_shift")
    )


def _shifts(sources: DataFrame) -> DataFrame:
    shift = F.when(F.col("kind").isin(*FIXED_CLOCK_KINDS), F.lit(0).cast("bigint")).otherwise(F.col("time_offset_ns").cast("bigint"))
    return sources.select("source_id", F.coalesce(shift, F.lit(0).cast("bigint")).alias("_shift"))


def fetch_range_with_offsets(samples: DataFrame, sources: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Range fetch on the shifted clock.

    The window is moved back by each source's own offset and tested on the stored time.
    The widest such window is also a plain constant filter, which reaches the scan.
    """
    shifts = _shifts(sources)
    least, most = shifts.agg(F.min("_shift"), F.max("_shift")).first()
    least, most = min(least or 0, 0), max(most or 0, 0)
    wide = samples.filter((F.col("ts_ns") >= start_ns - most) & (F.col("ts_ns") < end_ns - least))
    shift = F.coalesce("_shift", F.lit(0).cast("bigint"))
    inside = (F.col("ts_ns") >= F.lit(start_ns) - shift) & (F.col("ts_ns") < F.lit(end_ns) - shift)
    return wide.join(shifts, "source_id", "left").filter(inside).withColumn("ts_ns", F.col("ts_ns") + shift).drop("_shift")


def coalesce_intervals(
    intervals: DataFrame,
    by: Sequence[str],
    lo: int | None = None,
    hi: int | None = None,
    start: str = "start_ns",
    end: str = "end_ns",
    kind: str = "kind",
    target_rows: int | None = None,
) -> DataFrame:
    """Clamp to ``[lo, hi]``, drop empty intervals and merge strictly overlapping ones.

    Intervals that only touch stay apart; a merged interval keeps the kind of its first.
    """
    s, e = F.col(start), F.col(end)
    if lo is not None:
        s, e = F.greatest(s, F.lit(lo)), F.greatest(e, F.lit(lo))
    if hi is not None:
        s, e = F.least(s, F.lit(hi)), F.least(e, F.lit(hi))
    clamped = intervals.select(*by, s.alias(start), e.alias(end), kind).filter(F.col(end) > F.col(start))
    tie = [end, kind]
    tie_cell = F.col(end)
    first = OrderedScan(clamped, by, start, tie, target_rows, tie_cell).max_before("_reach", F.col(end))
    reach = first.run(keep=True)
    opens = F.col("_reach").isNull() | (F.col(start) >= F.col("_reach"))
    marked = reach.withColumn("_opens", opens.cast("int"))
    islands = OrderedScan(marked, by, start, tie, like=first).running_sum("_island", F.col("_opens")).run()
    first_kind = F.min_by(kind, F.struct(start, end, kind))
    return (
        islands.groupBy(*by, "_island")
        .agg(F.min(start).alias(start), F.max(end).alias(end), first_kind.alias(kind))
        .drop("_island")
    )
