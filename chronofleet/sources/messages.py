"""Message tables ``(source_id, topic, schema_name, encoding, log_time, payload)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofleet.operators.ranges import KEY

# Message schema names by the kind of channel they make.
VIDEO_SCHEMAS = (
    "foxglove.CompressedVideo",
    "foxglove_msgs/CompressedVideo",
    "foxglove_msgs/msg/CompressedVideo",
    "sensor_msgs/Image",
    "sensor_msgs/msg/Image",
    "sensor_msgs/CompressedImage",
    "sensor_msgs/msg/CompressedImage",
)
VIDEO_WORDS = ("image", "compressedvideo", "h264")
DOUBLE_SCHEMAS = ("foxglove.Float64", "std_msgs/Float64", "std_msgs/msg/Float64")
FLOAT_SCHEMAS = ("foxglove.Float32", "std_msgs/Float32", "std_msgs/msg/Float32")
VECTOR_SCHEMAS = ("foxglove.Vector3", "geometry_msgs/Vector3", "geometry_msgs/msg/Vector3")
ENUM_SUFFIXES = ("mode", "state", "status", "enum")


def infer_channel_kind(schema_name: Column, encoding: Column, enum_prefix: str) -> Column:
    """``struct<kind, dtype>`` of a message schema.

    ``enum_prefix`` is the vendor prefix (such as ``acme.``) under which names ending in
    mode, state, status or enum are enumerations. Unknown schemas are ``bytes``.
    """
    lower = F.lower(schema_name)
    video_word = lower.rlike("|".join(VIDEO_WORDS))
    enum = schema_name.startswith(enum_prefix) & lower.rlike(f"({'|'.join(ENUM_SUFFIXES)})$")
    kind = (
        F.when(schema_name.isin(*VIDEO_SCHEMAS), "video")
        .when((encoding == "protobuf") & video_word, "video")
        .when(schema_name.isin(*DOUBLE_SCHEMAS, *FLOAT_SCHEMAS), "scalar")
        .when(schema_name.isin(*VECTOR_SCHEMAS), "vector")
        .when(enum, "enum")
        .otherwise("bytes")
    )
    dtype = (
        F.when(kind == "video", F.lit(None).cast("string"))
        .when(schema_name.isin(*DOUBLE_SCHEMAS, *VECTOR_SCHEMAS), "f64")
        .when(schema_name.isin(*FLOAT_SCHEMAS), "f32")
        .when(kind == "enum", "i32")
    )
    return F.struct(kind.alias("kind"), dtype.alias("dtype"))


_STRICT = {"allowNonNumericNumbers": "false"}


def scalar_value(payload: Column) -> Column:
    """Number in ``value``, else in ``data``; NULL if neither is a number."""
    j = F.from_json(payload.cast("string"), "value DOUBLE, data DOUBLE", _STRICT)
    return F.coalesce(j["value"], j["data"])


def vector_value(payload: Column) -> Column:
    """``[x, y, z]``; NULL unless all three are numbers."""
    j = F.from_json(payload.cast("string"), "x DOUBLE, y DOUBLE, z DOUBLE", _STRICT)
    whole = j["x"].isNotNull() & j["y"].isNotNull() & j["z"].isNotNull()
    return F.when(whole, F.array(j["x"], j["y"], j["z"]))


def enum_code(payload: Column) -> Column:
    """Integer in ``value``; NULL, not truncated, outside 32 bits."""
    v = F.from_json(payload.cast("string"), "value BIGINT")["value"]
    return F.when(v.between(-(2**31), 2**31 - 1), v.cast("int"))


def extract_json_samples(messages: DataFrame, kind: str) -> DataFrame:
    """Samples of one channel kind; messages that do not decode are dropped."""
    decode = {"scalar": (scalar_value, "value"), "vector": (vector_value, "value"), "enum": (enum_code, "code")}
    fn, name = decode[kind]
    out = messages.select(
        "source_id",
        F.col("topic").alias("channel_id"),
        F.col("log_time").alias("ts_ns"),
        *[c for c in ("seq",) if c in messages.columns],
        fn(F.col("payload")).alias(name),
    )
    return out.filter(F.col(name).isNotNull())


# -- numeric leaves of decoded messages ------------------------------------------
def _scalar(t: T.DataType) -> bool:
    return isinstance(t, (T.NumericType, T.BooleanType))


def leaf_paths(schema: T.StructType, fixed_arrays: dict[str, int] | None = None, path: str = "") -> list[tuple[str, str]]:
    """``(path, kind)`` of every numeric leaf, kind ``scalar`` or ``vector``.

    A flat struct of numbers is a vector and its members are scalars too. Arrays count
    only when ``fixed_arrays`` names their path with a length; other arrays, strings and
    nested collections are skipped.
    """
    fixed_arrays = fixed_arrays or {}
    out = []
    for f in schema.fields:
        at = f"{path}.{f.name}" if path else f.name
        t = f.dataType
        if _scalar(t):
            out.append((at, "scalar"))
        elif isinstance(t, T.StructType):
            if t.fields and all(_scalar(g.dataType) for g in t.fields):
                out.append((at, "vector"))
            out += leaf_paths(t, fixed_arrays, at)
        elif isinstance(t, T.ArrayType) and _scalar(t.elementType) and at in fixed_arrays:
            out.append((at, "vector"))
    return out


def flatten_leaves(
    df: DataFrame, topic_col: str = "topic", struct_col: str = "message", ids: Sequence[str] = ("source_id", "ts_ns", "seq"),
    fixed_arrays: dict[str, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Scalar and vector samples of a decoded message struct, channel ``topic.path``.

    The paths come from the schema once; each row is then read a single time and only
    the leaves are.
    """
    root = df.schema[struct_col].dataType
    leaves = leaf_paths(root, fixed_arrays)

    def channel(path: str) -> Column:
        return F.concat(F.col(topic_col), F.lit(f".{path}")).alias("channel_id")

    def at(path: str) -> Column:
        return F.col(f"{struct_col}.{path}")

    scalar_cells, vector_cells = [], []
    for path, kind in leaves:
        if kind == "scalar":
            scalar_cells.append(F.struct(channel(path), at(path).try_cast("double").alias("value")))
            continue
        t = _type_at(root, path)
        if isinstance(t, T.StructType):
            value = F.array(*[at(f"{path}.{g.name}").try_cast("double") for g in t.fields])
        else:
            value = F.when(F.size(at(path)) == fixed_arrays[path], at(path).cast("array<double>"))
        vector_cells.append(F.struct(channel(path), F.when(at(path).isNotNull(), value).alias("value")))

    def long(cells: list[Column], kind: str) -> DataFrame:
        if not cells:
            return df.select(*ids).limit(0).withColumns({"channel_id": F.lit("").cast("string"), "value": F.lit(None).cast(kind)})
        rows = df.select(*ids, F.explode(F.array(*cells)).alias("z")).select(*ids, "z.*")
        return rows.filter(F.col("value").isNotNull())

    return long(scalar_cells, "double"), long(vector_cells, "array<double>")


def _type_at(schema: T.StructType, path: str) -> T.DataType:
    t: T.DataType = schema
    for part in path.split("."):
        t = t[part].dataType
    return t


def resolve_channel(ids: DataFrame, topics: DataFrame) -> DataFrame:
    """Split ``channel_id`` into ``topic`` and ``path``; the longest known topic wins.

    Every prefix that ends before a dot is looked up by equality, so no prefix test is
    run between all ids and all topics.
    """
    parts = F.split("channel_id", r"\.")
    n = F.size(parts)
    prefixes = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    rows = ids.select("*", F.explode(F.when(n > 1, prefixes)).alias("topic"))
    hits = rows.join(topics.select("topic").distinct(), "topic")
    best = hits.groupBy(*ids.columns).agg(F.max_by("topic", F.length("topic")).alias("topic"))
    return best.withColumn("path", F.expr("substring(channel_id, length(topic) + 2)"))


def enforce_shape(samples: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Keep samples whose width equals that of the first sample of their channel.

    ``value`` is an array; a scalar is an array of one.
    """
    width = F.size("value")
    first = samples.groupBy(*by).agg(F.min_by(width, F.struct("ts_ns", "seq")).alias("_w"))
    return samples.join(first, list(by)).filter(width == F.col("_w")).drop("_w")
