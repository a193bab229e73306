"""Wide tabular logs: column classes, time basis, and the long sample form."""

from __future__ import annotations

import csv
import sys
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofleet.functions.numeric import nan
from chronofleet.functions.time import group_time_ns, guess_time_unit, strict_ns, to_ts_ns
from chronofleet.sources.files import list_files, located

# The probes travel to the workers with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Column names taken for a time column.
TIME_NAMES = (
    "time", "timestamp", "ts", "t", "t_us", "t_ns", "t_ms", "t_s", "time_ns", "time_us", "time_ms", "time_s",
    "timestamp_ns", "timestamp_us", "timestamp_ms",
)

INTEGER = r"^[+-]?\d+$"
FLOAT = r"^(?i)[+-]?(inf|infinity|nan|(\d+\.?\d*|\.\d+)(e[+-]?\d+)?)$"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass(frozen=True)
class TimeBasis:
    """Which column is time, in which unit, shifted by how much."""

    time_column: str
    unit: str = "us"
    offset_ns: int = 0
    on_null: str = "drop"


def _is_numeric(t: T.DataType) -> bool:
    # Unsigned 64-bit Parquet integers arrive as DECIMAL(20, 0).
    return isinstance(t, _NUMERIC) or (isinstance(t, T.DecimalType) and t.scale == 0)


def _is_integral(t: T.DataType) -> bool:
    return isinstance(t, _INTEGRAL) or (isinstance(t, T.DecimalType) and t.scale == 0)


def classify_columns(raw: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Class of each text column: ``integer``, ``float`` or ``non_numeric``, per group of ``by``.

    Cells are trimmed and empty cells do not count. One non-numeric cell makes the
    column non-numeric; so does having no finite-or-infinite value at all. One pass.
    """
    columns = list(columns or [c for c in raw.columns if c not in by])
    aggs = []
    for i, c in enumerate(columns):
        cell = F.nullif(F.trim(F.col(f"`{c}`")), F.lit(""))
        is_int = F.when(cell.isNotNull(), cell.rlike(INTEGER) & cell.try_cast("bigint").isNotNull())
        is_float = cell.rlike(FLOAT)
        real = is_float & ~F.lower(cell).rlike("nan")
        flags = F.struct(
            F.coalesce(F.bool_and(is_int), F.lit(True)).alias("int"),
            F.coalesce(F.bool_and(is_float), F.lit(True)).alias("float"),
            F.coalesce(F.bool_or(real), F.lit(False)).alias("real"),
        )
        aggs.append(flags.alias(f"c{i}"))
    one = raw.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(c).alias("name"), F.col(f"c{i}").alias("f")) for i, c in enumerate(columns)])
    kind = (
        F.when(~F.col("f.real") | ~F.col("f.float"), "non_numeric").when(F.col("f.int"), "integer").otherwise("float")
    )
    return one.select(*by, F.inline(rows)).select(*by, "ordinal", "name", kind.alias("kind"))


def type_columns(raw: DataFrame, classes: dict[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """Numeric columns cast to BIGINT or DOUBLE by class; the others are dropped."""
    cast = {"integer": "bigint", "float": "double"}
    out = [F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).try_cast(cast[k]).alias(c) for c, k in classes.items() if k in cast]
    return raw.select(*keep, *out)


def _probed(files: DataFrame, probe: Callable) -> dict[str, list[str]]:
    """Paths by what ``probe(filesystem, path)`` says of each file; files are opened in tasks.

    The driver holds the paths, as any read of them does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for path in batch.column("path").to_pylist():
                said.append(probe(*located(path)))
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(said, pa.string())], names=["path", "said"])

    groups: dict[str, list[str]] = {}
    for r in files.select("path").mapInArrow(run, "path string, said string").orderBy("path").toLocalIterator():
        groups.setdefault(r["said"], []).append(r["path"])
    return groups


def _first_line(fs: pafs.FileSystem, path: str) -> str:
    line = b""
    with fs.open_input_stream(path) as f:
        while b"\n" not in line and (more := f.read(1 << 16)):
            line += more
    return line.split(b"\n")[0].rstrip(b"\r").decode("utf-8-sig", "replace")


def _footer(fs: pafs.FileSystem, path: str) -> str:
    with fs.open_input_file(path) as f:
        return pq.read_schema(f).remove_metadata().to_string()


def _column_names(header: str) -> list[str]:
    """Names that differ in more than case: a name that repeats gets its place, as does an empty one."""
    names = next(csv.reader([header]), [])
    many = Counter(n.lower() for n in names)
    taken = {n.lower() for n in names if n and many[n.lower()] == 1}
    out = []
    for i, n in enumerate(names):
        name, k = n, i
        if not n or many[n.lower()] > 1:
            name = f"{n or '_c'}{k}"
            while name.lower() in taken:
                k += len(names)
                name = f"{n or '_c'}{k}"
            taken.add(name.lower())
        out.append(name)
    return out


def read_csv_log(spark: SparkSession, paths: Sequence[str] | str) -> tuple[DataFrame, DataFrame]:
    """Typed wide frame with ``source_file`` and ``seq``, and the class of every column of every file.

    Each file is read by its own header, so columns may be in another order, or missing, from
    file to file; short rows read as empty cells. Names are compared without case: of one file's columns
    that differ in case only each gets its place in the name, those of several files are one. A column is numeric in the files where its
    cells are: elsewhere it is NULL, and its class says ``non_numeric``. It is BIGINT where no file
    needs DOUBLE.
    """
    raws, classes = [], []
    # Splits are packed by size, not by offset, so the row id alone gives no file order.
    seq = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    for header, own in _probed(list_files(spark, paths), _first_line).items():
        names = _column_names(header)
        if not names:
            continue
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        raw = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").csv(own)
        raw = raw.select("*", F.col("_metadata.file_path").alias("source_file"), seq.alias("seq"))
        raws.append((names, raw))
        classes.append(classify_columns(raw, names, ["source_file"]))
    if not raws:
        raise ValueError("no file has a header")
    classes_df = reduce(DataFrame.unionByName, classes)
    widest = classes_df.filter("kind <> 'non_numeric'").groupBy(F.lower("name").alias("name")).agg(F.min("kind").alias("kind"))  # float before integer
    kinds = {r["name"]: r["kind"] for r in widest.collect()}  # one row per column name
    bad = classes_df.filter("kind = 'non_numeric'").groupBy("source_file").agg(F.collect_set("name").alias("_bad")).withColumnRenamed("source_file", "_file")
    out = []
    for names, raw in raws:
        here = {n: kinds[n.lower()] for n in names if n.lower() in kinds}
        rows = type_columns(raw.join(bad, F.col("source_file") == F.col("_file"), "left"), here, ["source_file", "seq", "_bad"])
        fine = lambda n: ~F.array_contains(F.coalesce("_bad", F.array().cast("array<string>")), n)
        out.append(rows.select("source_file", "seq", *[F.when(fine(n), F.col(f"`{n}`")).alias(n) for n in here]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out), classes_df


def _parquet_files(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """Files named in ``paths``, whatever their ending, and Parquet files of the folders named there."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    named, folders = [], []
    for p in [paths] if isinstance(paths, str) else paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        found = at.getFileSystem(conf).globStatus(at)
        if not found:
            raise FileNotFoundError(p)
        for f in found:
            (named if f.isFile() else folders).append(f.getPath().toString())
    parts = [list_files(spark, named)] if named else []
    if folders:
        parts.append(list_files(spark, folders).filter(F.lower("name").rlike(r"\.(parquet|pq)$")))
    return reduce(DataFrame.unionByName, parts).distinct()


def read_parquet_log(spark: SparkSession, paths: Sequence[str] | str, basis: TimeBasis) -> DataFrame:
    """Samples of every numeric column of Parquet logs; other columns are never read.

    Files of one footer schema are read together, so a column that other files lack, or have
    with another type, is kept, and a file without a column has no samples of it. Files that
    ``paths`` name, or match, are all read; in folders those that end in .parquet or .pq in any
    case. A file without a Parquet footer is an error.
    """
    out = []
    seq = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    for own in _probed(_parquet_files(spark, paths), _footer).values():
        raw = spark.read.parquet(*own)
        numeric = [f.name for f in raw.schema if _is_numeric(f.dataType)]
        wide = raw.select(*numeric, F.col("_metadata.file_path").alias("source_id"), seq.alias("seq"))
        out.append(unpivot_channels(wide, basis))
    if not out:
        raise ValueError("no Parquet file found")
    return reduce(DataFrame.unionByName, out)


def inspect_log(df: DataFrame) -> DataFrame:
    """Columns with dtype and numeric flag; the suggested time column carries its unit.

    Only the schema and the first usable value of one column are looked at.
    """
    fields = df.schema.fields
    numeric = [f for f in fields if _is_numeric(f.dataType)]
    integral = [f for f in numeric if _is_integral(f.dataType)]
    named = [f for f in numeric if f.name.strip().lower() in TIME_NAMES]
    choice = next((g[0] for g in (named, integral, numeric, fields) if g), None)
    unit = "us"
    if choice is not None and _is_numeric(choice.dataType):
        v = F.col(f"`{choice.name}`").cast("double")
        usable = df.select(v.alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
        head = usable.select(guess_time_unit(F.col("v")).alias("unit")).limit(1).collect()
        unit = head[0]["unit"] if head else "us"
    rows = [
        (i, f.name, f.dataType.simpleString(), _is_numeric(f.dataType), f is choice, unit if f is choice else None)
        for i, f in enumerate(fields)
    ]
    schema = "ordinal int, name string, dtype string, is_numeric boolean, is_time boolean, unit string"
    return df.sparkSession.createDataFrame(rows, schema)


def unpivot_channels(wide: DataFrame, basis: TimeBasis, ids: Sequence[str] = ("source_id", "seq")) -> DataFrame:
    """Each numeric column but the time becomes a channel; missing values become NaN."""
    field = wide.schema[basis.time_column]
    floating = isinstance(field.dataType, (T.FloatType, T.DoubleType))
    ts = to_ts_ns(F.col(basis.time_column), basis.unit, basis.offset_ns, floating=floating, on_null=basis.on_null)
    skip = {*ids, basis.time_column}
    channels = [f.name for f in wide.schema if f.name not in skip and _is_numeric(f.dataType)]
    if not channels:
        raise ValueError("no numeric channel besides the time column")
    values = [F.coalesce(_as_double(F.col(c), wide.schema[c].dataType), nan()).alias(c) for c in channels]
    timed = wide.select(*ids, ts.alias("ts_ns"), *values).filter(F.col("ts_ns").isNotNull())
    return timed.unpivot([*ids, "ts_ns"], channels, "channel_id", "value")


def _as_double(c: Column, t: T.DataType) -> Column:
    return c.cast("int").cast("double") if isinstance(t, T.BooleanType) else c.cast("double")


def translate_group_time(rows: DataFrame, masters: DataFrame, start_ns: Column) -> DataFrame:
    """Absolute time of channel-group rows ``(group_id, t_rel, ...)``.

    Groups that are not in ``masters(group_id)`` have no time channel and are skipped.
    """
    kept = rows.join(masters.select("group_id").distinct(), "group_id", "left_semi")
    return kept.withColumn("ts_ns", group_time_ns(F.col("t_rel"), start_ns)).drop("t_rel")


# -- nested segment logs ---------------------------------------------------------
def explode_segment_logs(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scalar and vector samples of one-row-per-segment logs.

    Columns ``<signal>__t ARRAY<DOUBLE>`` hold seconds on a clock of their own and
    ``<signal>__value`` the readings. All clocks of a segment are moved so that its
    earliest finite time is the start encoded in ``segment_id``
    (``<device>|YYYY-MM-DD--HH-MM-SS/<n>``). Readings are scalars, or lists whose rule
    follows from the signal name: ``wheel_speed`` needs three entries and a fourth is
    optional, ``gnss`` drops NaN, other lists need three.
    """
    stamps = [c for c in segments.columns if c.endswith("__t")]
    if not stamps:
        raise ValueError("no __t column")

    def finite_min(c: str) -> Column:
        return F.array_min(F.filter(c, lambda t: t.isNotNull() & ~F.isnan(t)))

    least = F.least(*map(finite_min, stamps)) if len(stamps) > 1 else finite_min(stamps[0])
    text = F.regexp_extract("segment_id", r"^[^|]*\|(\d{4}-\d{2}-\d{2}--\d{2}-\d{2}-\d{2})/", 1)
    start = F.unix_seconds(F.try_to_timestamp(text, F.lit("yyyy-MM-dd--HH-mm-ss"))) * 1_000_000_000
    base = segments.withColumn("_t0", least).withColumn("_start", start)
    base = base.filter(F.col("_t0").isNotNull() & F.col("_start").isNotNull())
    scalars, vectors = [], []
    for t_col in stamps:
        signal = t_col[: -len("__t")]
        v_col = f"{signal}__value"
        if v_col not in segments.columns:
            continue
        element = segments.schema[v_col].dataType.elementType
        rows = base.select(
            "segment_id", "_t0", "_start", F.posexplode(F.arrays_zip(F.col(t_col).alias("t"), F.col(v_col).alias("v"))).alias("_i", "_z")
        )
        rows = rows.filter(F.col("_z.t").isNotNull() & ~F.isnan("_z.t"))
        ts = F.col("_start") + ((F.col("_z.t") - F.col("_t0")) * 1e9).cast("bigint")
        seq = F.col("_i").cast("bigint").alias("seq")
        v = F.col("_z.v")
        if not isinstance(element, T.ArrayType):
            scalars.append(rows.select("segment_id", F.lit(signal).alias("channel_id"), ts.alias("ts_ns"), seq, v.cast("double").alias("value")))
            continue
        if "wheel_speed" in signal:
            wheels = F.array(*[F.struct(F.lit(f"{signal}_{n}").alias("c"), F.get(v, F.lit(i)).alias("v")) for i, n in enumerate(("fl", "fr", "rl", "rr"))])
            split = rows.filter(F.size(v) >= 3).select("segment_id", ts.alias("ts_ns"), seq, F.size(v).alias("_n"), F.posexplode(wheels).alias("_w", "_x"))
            split = split.filter(F.col("_w") < F.col("_n"))
            scalars.append(split.select("segment_id", F.col("_x.c").alias("channel_id"), "ts_ns", "seq", F.col("_x.v").cast("double").alias("value")))
        elif "speed" in signal:
            scalars.append(rows.filter(F.size(v) >= 1).select("segment_id", F.lit(signal).alias("channel_id"), ts.alias("ts_ns"), seq, F.get(v, F.lit(0)).cast("double").alias("value")))
        else:
            xyz = F.slice(v, 1, 3).cast("array<double>")
            kept = rows.filter(F.size(v) >= 3)
            if "gnss" in signal.lower():
                kept = kept.filter(~F.exists(xyz, F.isnan))
            vectors.append(kept.select("segment_id", F.lit(signal).alias("channel_id"), ts.alias("ts_ns"), seq, xyz.alias("value")))
    spark = segments.sparkSession
    head = "segment_id string, channel_id string, ts_ns bigint, seq bigint, value "
    return _union(scalars, spark, head + "double"), _union(vectors, spark, head + "array<double>")


def _union(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- inline batches --------------------------------------------------------------
def validate_inline(batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples of accepted inline sources, and the rejected sources with a reason.

    ``batches(source_id, channels ARRAY<STRUCT<name, kind, timestamps, values>>)``.
    Each channel needs a name unique in its source, as many times as values, and
    non-decreasing decimal-string times. One violation rejects the whole source.
    """
    names = F.transform("channels", lambda c: F.trim(c["name"]))

    def bad(c: Column) -> Column:
        ts = F.transform(c["timestamps"], strict_ns)
        n = F.size(c["timestamps"])
        falls = F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.coalesce(F.get(ts, i) < F.get(ts, i - 1), F.lit(False)))
        return (
            F.when(F.coalesce(F.length(F.trim(c["name"])), F.lit(0)) == 0, "channel without a name")
            .when(F.coalesce(n, F.lit(-1)) < 1, "channel without samples")
            .when(n != F.coalesce(F.size(c["values"]), F.lit(-1)), "times and values differ in number")
            .when(F.exists(ts, lambda t: t.isNull()), "time is not a decimal integer")
            .when(falls, "times decrease")
            .when(F.exists(c["values"], lambda v: v.isNull()), "value is not a number")
        )

    reasons = F.filter(F.transform("channels", bad), lambda r: r.isNotNull())
    no_name = F.length(F.coalesce(F.trim("source_id"), F.lit(""))) == 0
    reason = (
        F.when(no_name, "source without a name")
        .when(F.coalesce(F.size("channels"), F.lit(0)) < 1, "source without channels")
        .when(F.size(F.array_distinct(names)) != F.size(names), "channel name repeats")
        .otherwise(F.get(reasons, F.lit(0)))
    )
    judged = batches.withColumn("reason", reason)
    rejected = judged.filter(F.col("reason").isNotNull()).select("source_id", "reason")
    rows = judged.filter(F.col("reason").isNull()).select(F.trim("source_id").alias("source_id"), F.explode("channels").alias("c"))
    zipped = F.arrays_zip(F.col("c.timestamps").alias("t"), F.col("c.values").alias("v"))
    rows = rows.select("source_id", F.trim("c.name").alias("channel_id"), F.coalesce("c.kind", F.lit("scalar")).alias("kind"), F.posexplode(zipped).alias("seq", "z"))
    v = F.col("z.v")
    whole = F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(0.0)).otherwise(F.signum(v) * F.floor(F.abs(v)).cast("double"))
    # 32-bit wrap of the truncated value.
    wrapped = F.pmod(whole + 2.0**31, F.lit(2.0**32)) - 2.0**31
    value = F.when(F.col("kind") == "enum", wrapped).otherwise(v)
    samples = rows.select(
        "source_id", "channel_id", F.when(F.col("kind") == "enum", "enum").otherwise("scalar").alias("kind"),
        strict_ns(F.col("z.t")).alias("ts_ns"), F.col("seq").cast("bigint").alias("seq"), value.alias("value"),
    )
    return samples, rejected
