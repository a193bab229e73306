"""Row counts per series and time slice: what an ordered scan needs to know to cut hot series.

A histogram has one row per series and slice of ``2 ** SLICE_BITS`` ns (about a minute) that
holds rows. It comes from one aggregate that combines on the map side, adds up with other
histograms of the same or finer series, and is stored beside the sample lake, so that scans
of the lake are planned without reading a sample. A histogram of more rows than a frame holds
(the lake before a filter) still gives valid cuts: they only have to divide time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE_BITS = 36
#: Record and frame numbers are dense: a slice of so many bits holds that many rows.
DENSE_BITS = 16
#: Level of the row that stands for a whole series.
WHOLE = 64


def time_histogram(frame: DataFrame, by: Sequence[str], ts: str = "ts_ns", bits: int = SLICE_BITS) -> DataFrame:
    """(by, slice, n, lo, hi): rows, first and last time per series and slice; NULL times have a NULL slice."""
    counted = frame.groupBy(*by, F.shiftright(F.col(ts).cast("bigint"), bits).alias("slice"))
    return counted.agg(F.count(F.lit(1)).alias("n"), F.min(F.col(ts).cast("bigint")).alias("lo"), F.max(F.col(ts).cast("bigint")).alias("hi"))


def merged(histogram: DataFrame, by: Sequence[str]) -> DataFrame:
    """The histogram of coarser series, or of several histograms in one frame."""
    return histogram.groupBy(*by, "slice").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def hot_slices(histogram: DataFrame, by: Sequence[str], target: int, bits: int | None = SLICE_BITS, most: int | None = None) -> tuple[list, int]:
    """Slices of every second width that hold more than ``target`` rows, and the rows of the largest series.

    One job. Rows are (by, level, at, n, lo, hi): the slice ``at`` of ``2 ** level`` ns, or a
    whole series at level WHOLE, which is all there is without ``bits``. At most rows / target
    of each level exist; ``most`` limits what is brought to the driver.
    """
    by = list(by)
    sized = histogram.withColumn("_total", F.sum("n").over(Window.partitionBy(*by)))
    levels = F.array(*[F.lit(level) for level in [*([] if bits is None else range(bits, 63, 2)), WHOLE]])
    cells = sized.filter(F.col("_total") > target).withColumn("level", F.explode(levels))
    at = F.when(F.col("level") == WHOLE, F.lit(0).cast("bigint")).otherwise(F.expr(f"shiftright(slice, level - {bits or 0})"))
    cells = cells.groupBy(*by, "level", at.alias("at")).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cells = cells.filter(F.col("n") > target)
    if most is not None:
        cells = cells.limit(most)
    nothing = [F.lit(None).cast(histogram.schema[c].dataType).alias(c) for c in by]
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("at", "bigint"))]
    largest = sized.agg(F.max("_total").alias("n"))
    largest = largest.select(*nothing, *empty, F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), *[F.lit(None).cast("bigint").alias(c) for c in ("lo", "hi")])
    rows = cells.unionByName(largest).collect()
    return [r for r in rows if r["level"] is not None], next(r["n"] for r in rows if r["level"] is None)
