"""Ordered scans (lag, lead, fill, rank, running aggregates) that split hot series.

``Window.partitionBy(series).orderBy(ts)`` puts a whole series in one task, and one
series may hold a large share of all rows. An :class:`OrderedScan` looks at a histogram
of rows per series and time slice first: the one stored with the lake, else one counting
job. Series below ``target_rows`` use the plain window. A larger one is cut into cells of
consecutive time:

1. a cell above the target is cut into power-of-two time slices sized from its own
   count and its own first and last time; the histogram tells which of these are still
   too large, so a dense minute inside a sparse year is found without another job;
2. only where a single slice of the histogram is above the target, or the order is
   no time, cells are counted again until they fit;
3. a cell that is one single nanosecond cannot be cut by time and is cut by the
   sequence column that orders its ties.

Each cell is scanned by its own window. What crosses cell borders (last value, count,
sum, maximum so far) is pre-aggregated to one row per cell with map-side combining,
accumulated over that small frame, and joined back. Cells are a pure function of the
data, so a recomputed task lands on the same cells.

Only cells above the target are ever collected: at most ``total rows / target`` of each
width, and the target is doubled until these fit ``MAX_HOT_CELLS``. Keys may be NULL. Carries are broadcast
only if the number of cells times the width of a row is proven to be under ``CARRY_BYTES``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofleet.plans.histogram import SLICE_BITS, WHOLE, hot_slices, merged, time_histogram

TARGET_ROWS = 1_000_000
MAX_HOT_CELLS = 100_000
CARRY_BYTES = 64 << 20
FINE_PIECES = 1_024
TIE_BITS = 17

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FIXED = (*_INTEGRAL, T.FloatType, T.DoubleType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.DecimalType)


def fixed_width(t: T.DataType) -> int | None:
    """Bytes of a value whose size does not depend on the data, at most; None for other types."""
    if isinstance(t, T.StructType):
        parts = [fixed_width(f.dataType) for f in t.fields]
        return None if None in parts else 24 + sum(parts)
    return 24 if isinstance(t, _FIXED) else None


def order_prefix(cols: Sequence[Column], dtypes: Sequence[T.DataType], bits: int) -> list[Column]:
    """Order-preserving coarse form of a lexicographic key: exact head, coarse last part."""
    *head, last = cols
    kind = dtypes[-1]
    if isinstance(kind, _INTEGRAL):
        return [*head, F.shiftright(last.cast("bigint"), bits)]
    if isinstance(kind, T.StructType) and kind.fields:
        parts = [last[f.name] for f in kind.fields]
        return [*head, *order_prefix(parts, [f.dataType for f in kind.fields], bits)]
    return [*head, last]


class OrderedScan:
    """Collects column requests over one ordering, then adds them in one plan."""

    def __init__(
        self,
        df: DataFrame,
        by: Sequence[str],
        ts: str = "ts_ns",
        tie: Sequence[str] = ("seq",),
        target_rows: int | None = None,
        tie_cell: Column | None = None,
        like: OrderedScan | None = None,
        at_most: int | None = None,
        histogram: DataFrame | None = None,
        slice_bits: int | None = None,
        sized: OrderedScan | None = None,
    ):
        self.df, self.by, self.ts, self.tie = df, list(by), ts, list(tie)
        self._columns = df.columns
        if not self.by:
            self.by, self.df = ["_one"], df.withColumn("_one", F.lit(0))
            histogram = None if histogram is None else histogram.withColumn("_one", F.lit(0))
        self.target = max(1, target_rows or TARGET_ROWS)
        self._tie_cell = tie_cell
        self._like = like
        self._at_most = at_most
        self.largest = at_most
        self._histogram = histogram
        # Times are ns by contract; other orders say how dense they are, or are counted as they are.
        self._bits = slice_bits if slice_bits is not None else SLICE_BITS if ts.endswith("_ns") or histogram is not None else None
        self._rows: list | None = None
        if sized is not None and sized.size() is not None:  # counts of the same series with no fewer rows
            self._rows, self.largest, self.target, self._at_most = sized._rows, sized.largest, sized.target, sized._at_most
        self._hot, self._tied, self._cells = False, False, 0
        self._null_keys, self._key_bytes = False, 0
        self._ops: list[tuple[str, str, Column | None]] = []

    # -- requests ---------------------------------------------------------------
    def lag(self, name: str, value: Column) -> OrderedScan:
        """``value`` of the previous row as ``struct<v>``; NULL on the first row."""
        return self._add("lag", name, value)

    def lead(self, name: str, value: Column) -> OrderedScan:
        """``value`` of the next row as ``struct<v>``; NULL on the last row."""
        return self._add("lead", name, value)

    def fill(self, name: str, value: Column) -> OrderedScan:
        """Last non-NULL ``value`` up to and including this row."""
        return self._add("fill", name, value)

    def rank(self, name: str) -> OrderedScan:
        """1-based row number."""
        return self._add("rank", name, None)

    def running_sum(self, name: str, value: Column) -> OrderedScan:
        """Sum of ``value`` up to and including this row."""
        return self._add("sum", name, value)

    def max_before(self, name: str, value: Column) -> OrderedScan:
        """Maximum of ``value`` over the rows before this one."""
        return self._add("max", name, value)

    def _add(self, kind: str, name: str, value: Column | None) -> OrderedScan:
        self._ops.append((kind, name, value))
        return self

    # -- planning ---------------------------------------------------------------
    def _hot_cells(self, frame: DataFrame, keys: list[str]) -> list:
        # Bounded: every returned cell holds more than ``target`` of ``total`` rows.
        return (
            frame.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("_n"), F.min(self.ts).alias("_lo"), F.max(self.ts).alias("_hi"))
            .filter(F.col("_n") > self.target)
            .collect()
        )

    def _counted(self, key_frame: DataFrame) -> list[tuple]:
        """(key, level, at, rows, first, last) of hot slices of all widths; sets ``largest``. One job.

        Whole series only, where the order is no time.
        """
        # Keys may have any name, those of a histogram's columns too.
        keys = [f"_k{i}" for i in range(len(self.by))]
        renamed = [F.col(c).alias(k) for c, k in zip(self.by, keys)]
        if self._histogram is not None:
            sizes = merged(self._histogram.select(*renamed, "slice", "n", "lo", "hi"), keys)
        elif self._bits is None:
            sizes = key_frame.select(*renamed, F.col(self.ts).alias("_ts")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_ts").alias("lo"), F.max("_ts").alias("hi"))
            sizes = sizes.select(*keys, F.lit(None).cast("bigint").alias("slice"), "n", "lo", "hi")
        else:
            sizes = time_histogram(key_frame.select(*renamed, F.col(self.ts).alias("_ts")), keys, "_ts", self._bits)
        while True:
            rows, self.largest = hot_slices(sizes, keys, self.target, self._bits, 8 * MAX_HOT_CELLS + 1)
            if len(rows) <= 8 * MAX_HOT_CELLS:
                return [(tuple(r[k] for k in keys), r["level"], r["at"], r["n"], r["lo"], r["hi"]) for r in rows]
            self.target *= 2

    def size(self) -> int:
        """Rows of the largest series, or the bound that was given; counts at most once."""
        if self._rows is None and (self._at_most is None or self._at_most > self.target):
            self._rows = self._counted(self.df.select(*self.by, self.ts))
        return self.largest

    def _cut(self, n: int, lo: int, hi: int, cells: int) -> int:
        """Bits of the slices a cell is cut into."""
        share = -(-n // self.target)
        # Finer than needed while cells are few, which saves rounds on uneven time.
        pieces = max(2 * share, min(16 * share, FINE_PIECES, MAX_HOT_CELLS // max(1, cells)))
        return max(0, ((hi - lo) // pieces).bit_length() - 1)

    def _split(self, frame: DataFrame) -> tuple[DataFrame, bool] | None:
        """``frame`` with ``_cell`` and ``_tie``, or None when no series is hot."""
        # A caller that knows a bound on the rows per series saves counting them again.
        if self.size() <= self.target:
            return None
        key_frame, counted = frame.select(*self.by, self.ts), self._rows
        by_types = [key_frame.schema[c] for c in self.by]
        by_types = [T.StructField(f.name, f.dataType) for f in by_types]
        cut_schema = T.StructType([*by_types, T.StructField("_at", T.LongType()), T.StructField("_bits", T.IntegerType())])
        self._null_keys = any(v is None for key, *_ in counted for v in key)
        self._key_bytes = max(sum(24 + len(str(v)) for v in key) for key, *_ in counted)
        by_level = defaultdict(list)
        for key, level, at, *rest in counted:
            by_level[key, level].append((at, *rest))
        cuts, ties, unknown = [], set(), False
        # Cells to cut: (key, start or None for a whole series, bits, rows, first and last time).
        todo = [(key, None, WHOLE, *rest) for key, level, _, *rest in counted if level == WHOLE]
        while todo:
            rows, children = [], []
            for key, at, bits, n, lo, hi in todo:
                if lo is None:
                    continue
                if lo == hi:
                    ties.add((*key, lo if at is None else at))
                    if at is None:
                        rows.append((*key, None, 0))
                    continue
                own = self._cut(n, lo, hi, len(todo))
                known = self._bits is not None and own >= self._bits
                if known:
                    own = min(own - (own - self._bits) % 2, 62)
                    for c, *rest in by_level[key, own]:
                        if c is not None and (at is None or at <= c << own < at + (1 << bits)):
                            children.append((key, c << own, own, *rest))
                unknown |= not known
                rows.append((*key, at, own))
                self._cells += ((hi - lo) >> own) + 2
            if not rows:
                break
            cuts.append(self._local(rows, cut_schema))
            todo = children
        while unknown:
            tagged = self._apply(key_frame, cuts).filter(F.col("_cell").isNotNull())
            rows, hot = [], self._hot_cells(tagged, [*self.by, "_cell"])
            for r in hot:
                key = tuple(r[c] for c in self.by)
                if (*key, r["_cell"]) in ties:
                    continue
                if r["_lo"] == r["_hi"]:
                    ties.add((*key, r["_cell"]))
                    continue
                rows.append((*key, r["_cell"], self._cut(r["_n"], r["_lo"], r["_hi"], len(hot))))
                self._cells += ((r["_hi"] - r["_lo"]) >> rows[-1][-1]) + 2
            if not rows:
                break
            cuts.append(self._local(rows, cut_schema))
        tagged = self._apply(frame, cuts)
        tie_schema = T.StructType([*by_types, T.StructField("_at", T.LongType())])
        if ties:
            mark = self._local(list(ties), tie_schema).withColumn("_tied", F.lit(True))
            tagged = self._join_cell(tagged, mark)
            tie_cell = self._tie_cell
            if tie_cell is None:
                tie_types = [frame.schema[c].dataType for c in self.tie]
                tie_cell = F.struct(*order_prefix([F.col(c) for c in self.tie], tie_types, TIE_BITS))
            tagged = tagged.withColumn("_tie", F.when(F.col("_tied"), tie_cell)).drop("_tied")
        else:
            tagged = tagged.withColumn("_tie", F.lit(0))
        return tagged, bool(ties)

    def _local(self, rows: list[tuple], schema: T.StructType) -> DataFrame:
        return self.df.sparkSession.createDataFrame(rows, schema)

    def _join_cell(self, left: DataFrame, right: DataFrame, how: str = "left", whole: bool = False) -> DataFrame:
        names = {c: f"_r_{c}" for c in [*self.by, "_at"]}
        right = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
        cond = F.lit(True) if whole else F.col("_cell") == F.col("_r__at")
        for c in self.by:
            cond = cond & self._same(left[c], F.col(names[c]))
        # A few times MAX_HOT_CELLS rows at most.
        return left.join(F.broadcast(right), cond, how).drop(*names.values())

    def _same(self, left: Column, right: Column) -> Column:
        """Equality of keys; of NULL ones only where a hot series has one."""
        return left.eqNullSafe(right) if self._null_keys else left == right

    def _apply(self, frame: DataFrame, cuts: list[DataFrame], how: str = "left") -> DataFrame:
        out = frame.withColumn("_cell", F.lit(None).cast("bigint"))
        for i, cut in enumerate(cuts):
            out = self._join_cell(out, cut, how, whole=i == 0)  # the first cut is of whole series
            slice_start = F.expr(f"shiftleft(shiftright(`{self.ts}`, _bits), _bits)")
            out = out.withColumn("_cell", F.when(F.col("_bits").isNull(), F.col("_cell")).otherwise(slice_start)).drop("_bits")
        return out

    # -- execution --------------------------------------------------------------
    def run(self, keep: bool = False) -> DataFrame:
        """The frame with the requested columns.

        ``keep`` leaves the cell columns in place, so that a scan over the same ordering
        built with ``like=`` this one plans nothing and shuffles nothing again.
        """
        frame = self.df
        base_cols = [c for c in self._columns if keep or c not in ("_cell", "_tie")]
        inputs = []
        for i, (kind, _, value) in enumerate(self._ops):
            if value is not None:
                inputs.append((value if kind in ("sum", "max", "fill") else F.struct(value.alias("v"))).alias(f"_in{i}"))
        frame = frame.select("*", *inputs)
        if self._like is None:
            split = self._split(frame)
        else:
            split = (frame, self._like._tied) if self._like._hot else None
        order = [self.ts, *self.tie]
        if split is None:
            out = self._windows(frame, Window.partitionBy(*self.by).orderBy(*order), carry=False)
        else:
            tagged, tied = split
            self._hot, self._tied = True, tied
            cell = [*self.by, "_cell", "_tie"]
            carry = self._carries(tagged, cell)
            width = fixed_width(carry.drop(*self.by).schema)
            if not tied and width is not None and self._cells * (width + self._key_bytes) <= CARRY_BYTES:
                carry = F.broadcast(carry)  # one row of known width per cell
            names = {c: f"_c_{c}" for c in cell}
            carry = carry.select(*[F.col(c).alias(names.get(c, c)) for c in carry.columns])
            # Carries exist for cut series only, whose cell is never NULL.
            cond = tagged["_cell"] == F.col(names["_cell"])
            if tied:
                cond = cond & tagged["_tie"].eqNullSafe(F.col(names["_tie"]))
            for c in self.by:
                cond = cond & self._same(tagged[c], F.col(names[c]))
            joined = tagged.join(carry, cond, "left").drop(*names.values())
            out = self._windows(joined, Window.partitionBy(*cell).orderBy(*order), carry=True)
        if keep and self._hot:
            base_cols = [*base_cols, *[c for c in ("_cell", "_tie") if c not in base_cols]]
        return out.select(*base_cols, *[name for _, name, _ in self._ops])

    def _windows(self, frame: DataFrame, w, carry: bool) -> DataFrame:
        cumulative = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        new = {}
        for i, (kind, name, _) in enumerate(self._ops):
            x, c = F.col(f"_in{i}"), F.col(f"_carry{i}")
            if kind == "lag":
                new[name] = F.coalesce(F.lag(x).over(w), c) if carry else F.lag(x).over(w)
            elif kind == "lead":
                new[name] = F.coalesce(F.lead(x).over(w), c) if carry else F.lead(x).over(w)
            elif kind == "fill":
                local = F.last(x, ignorenulls=True).over(cumulative)
                new[name] = F.coalesce(local, c) if carry else local
            elif kind == "rank":
                local = F.row_number().over(w).cast("bigint")
                new[name] = local + F.coalesce(c, F.lit(0)) if carry else local
            elif kind == "sum":
                local = F.sum(x).over(cumulative)
                new[name] = F.coalesce(local + F.coalesce(c, F.lit(0)), local, c) if carry else local
            else:
                local = F.max(x).over(before)
                new[name] = F.greatest(local, c) if carry else local
        return frame.select("*", *[expr.alias(name) for name, expr in new.items()])

    def _carries(self, tagged: DataFrame, cell: list[str]) -> DataFrame:
        key = F.struct(self.ts, *self.tie)
        states, carries = [], []
        w = Window.partitionBy(*self.by).orderBy("_cell", "_tie")
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        later = w.rowsBetween(1, Window.unboundedFollowing)
        for i, (kind, _, _) in enumerate(self._ops):
            x, s = F.col(f"_in{i}"), F.col(f"_s{i}")
            if kind == "lag":
                states.append(F.max_by(x, key).alias(f"_s{i}"))
                carry = F.last(s, ignorenulls=True).over(earlier)
            elif kind == "lead":
                states.append(F.min_by(x, key).alias(f"_s{i}"))
                carry = F.first(s, ignorenulls=True).over(later)
            elif kind == "fill":
                states.append(F.max_by(x, F.when(x.isNotNull(), key)).alias(f"_s{i}"))
                carry = F.last(s, ignorenulls=True).over(earlier)
            elif kind == "rank":
                states.append(F.count(F.lit(1)).alias(f"_s{i}"))
                carry = F.sum(s).over(earlier)
            elif kind == "sum":
                states.append(F.sum(x).alias(f"_s{i}"))
                carry = F.sum(s).over(earlier)
            else:
                states.append(F.max(x).alias(f"_s{i}"))
                carry = F.max(s).over(earlier)
            carries.append(carry.alias(f"_carry{i}"))
        cells = tagged.filter(F.col("_cell").isNotNull()).groupBy(*cell).agg(*states)
        return cells.select(*cell, *carries)
