"""Integer-nanosecond time: units, normalisation, parsing and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronofleet.functions.numeric import double_to_long, int_div, saturating_add, saturating_multiply

# Nanoseconds per unit.
UNIT_NS = {"ns": 1, "us": 1_000, "ms": 1_000_000, "s": 1_000_000_000}

# Fixed value: nominal frame period in ns when a frame carries no timestamp.
FRAME_PERIOD_NS = 33_333_333


def guess_time_unit(c: Column) -> Column:
    """Unit name from the magnitude of one raw time value."""
    x = F.abs(c.cast("double"))
    return (
        F.when(x >= 1e17, "ns")
        .when(x >= 1e14, "us")
        .when(x >= 1e11, "ms")
        .when(x >= 1e8, "s")
        .otherwise("us")
    )


def to_ts_ns(c: Column, unit: str, offset_ns: int = 0, *, floating: bool = False, on_null: str = "drop") -> Column:
    """``raw * unit + offset`` as BIGINT nanoseconds.

    Integer input stays in 64-bit arithmetic and saturates; floating input is scaled
    and rounded. ``on_null="drop"`` gives NULL for a missing or NaN time (the caller
    filters it), ``"zero"`` treats it as raw 0.
    """
    scale = UNIT_NS[unit]
    if floating:
        raw = c.cast("double")
        scaled = F.when(~F.isnan(raw), double_to_long(raw * float(scale)))
    else:
        scaled = saturating_multiply(c.cast("bigint"), scale)
    if on_null == "zero":
        scaled = F.coalesce(scaled, F.lit(0).cast("bigint"))
    elif on_null != "drop":
        raise ValueError(f"on_null must be 'drop' or 'zero', not {on_null!r}")
    return saturating_add(scaled, F.lit(offset_ns).cast("bigint"))


def group_time_ns(t_rel: Column, start_ns: Column) -> Column:
    """Absolute ns of a relative time in seconds; NaN or NULL falls on the start."""
    return saturating_add(start_ns.cast("bigint"), F.coalesce(double_to_long(t_rel.cast("double") * 1e9), F.lit(0).cast("bigint")))


def iso_ns(text: Column) -> Column:
    """Loose ISO-8601 text to ns: date, optional time, up to nine fraction digits, optional Z."""
    form = r"^(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ](\d+)(?::(\d+))?(?::(\d+))?(?:\.(\d*))?)?Z?$"
    t = F.trim(text)

    def group(i: int) -> Column:
        return F.coalesce(F.regexp_extract(t, form, i).try_cast("bigint"), F.lit(0).cast("bigint"))

    date = F.concat_ws("-", F.lpad(F.regexp_extract(t, form, 1), 4, "0"), F.lpad(F.regexp_extract(t, form, 2), 2, "0"), F.lpad(F.regexp_extract(t, form, 3), 2, "0"))
    day = F.unix_seconds(F.try_to_timestamp(date, F.lit("yyyy-MM-dd")))
    fraction = F.rpad(F.substring(F.regexp_extract(t, form, 7), 1, 9), 9, "0").try_cast("bigint")
    seconds = day + group(4) * 3600 + group(5) * 60 + group(6)
    return F.when(t.rlike(form), seconds * 1_000_000_000 + F.coalesce(fraction, F.lit(0).cast("bigint")))


def frame_ts_ns(text: Column, is_number: Column, frame_no: Column, iso: bool = True) -> Column:
    """Frame timestamp to ns.

    A JSON number above 1e15 in magnitude is ns already, a smaller one is seconds. Text
    is ISO-8601 (or a plain integer of ns with ``iso=False``). Anything else falls back
    to the frame number at the nominal frame period.
    """
    value = F.when(is_number, text.try_cast("double"))
    number = F.when(F.abs(value) > 1e15, double_to_long(value)).otherwise(double_to_long(value * 1e9))
    trimmed = F.trim(text)
    written = iso_ns(text) if iso else F.when(trimmed.rlike(r"^[+-]?\d+$"), trimmed.try_cast("bigint"))
    synthetic = saturating_multiply(frame_no.cast("bigint"), FRAME_PERIOD_NS)
    return F.coalesce(number, F.when(~F.coalesce(is_number, F.lit(False)), written), synthetic)


def parse_ns(text: Column) -> Column:
    """Signed decimal string to BIGINT; blank or a lone sign is 0, anything else NULL."""
    t = F.trim(text)
    return F.when(t.isin("", "-", "+"), F.lit(0).cast("bigint")).when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))


def strict_ns(text: Column) -> Column:
    """Signed decimal string to BIGINT; anything else, blank included, is NULL."""
    return F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint"))


def _two(c: Column) -> Column:
    """At least two digits; longer numbers are kept whole."""
    return F.when(c < 10, F.concat(F.lit("0"), c.cast("string"))).otherwise(c.cast("string"))


def fmt_duration(ns: Column) -> Column:
    """``[hh:]mm:ss.mmm``; negative durations show as zero."""
    total_ms = int_div(F.greatest(ns, F.lit(0).cast("bigint")), 1_000_000)
    total_s = int_div(total_ms, 1000)
    total_min = int_div(total_s, 60)
    hours = int_div(total_min, 60)
    millis = F.lpad((total_ms % 1000).cast("string"), 3, "0")
    core = F.concat(_two(total_min % 60), F.lit(":"), _two(total_s % 60), F.lit("."), millis)
    return F.when(hours > 0, F.concat(_two(hours), F.lit(":"), core)).otherwise(core)


def fmt_relative(ns: Column, start_ns: Column) -> Column:
    """Duration text since ``start_ns``; earlier times show as zero."""
    return fmt_duration(F.when(ns >= start_ns, ns - start_ns).otherwise(F.lit(0).cast("bigint")))


def fmt_absolute(ns: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS.mmm`` in UTC (truncating toward zero to the millisecond)."""
    return F.date_format(F.timestamp_millis(int_div(ns, 1_000_000)), "yyyy-MM-dd HH:mm:ss.SSS")
