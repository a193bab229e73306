"""Fixed-record binary logs described by a JSON recipe.

A file is cut into byte ranges that start on record borders, so one large log is read by many
tasks; each range is decoded with numpy record views and leaves as Arrow batches. The ranges
are rows of a frame made from the listing of the files.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.operators.frames import ranked_pick
from chronofleet.plans.histogram import DENSE_BITS
from chronofleet.plans.scan import OrderedScan
from chronofleet.sources.files import list_files, located, task_count

# The acceptance threshold, time units.
MIN_COVERAGE = 0.99
UNITS = {"nanos": 1, "micros": 1_000, "millis": 1_000_000, "seconds": 1_000_000_000}
DTYPES = {"u8": "u1", "i8": "i1", "u16": "u2", "i16": "i2", "u32": "u4", "i32": "i4", "u64": "u8", "i64": "i8", "f32": "f4", "f64": "f8"}

SCHEMA = "source_id string, channel_id string, ts_ns bigint, seq bigint, value double"
_ARROW = pa.schema(
    [("source_id", pa.string()), ("channel_id", pa.string()), ("ts_ns", pa.int64()), ("seq", pa.int64()), ("value", pa.float64())]
)
_I64 = np.iinfo(np.int64)

# The decoder travels to the workers with the task, so they need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Field:
    name: str
    offset: int
    dtype: str
    endian: str
    scale: float
    value_offset: float

    @property
    def numpy(self) -> str:
        return (">" if self.endian == "be" else "<") + DTYPES[self.dtype]


@dataclass(frozen=True)
class Recipe:
    """A checked recipe."""

    header: int
    record: int
    time: Field
    time_scale: int
    time_offset: int
    channels: tuple[tuple[str, Field], ...]

    @classmethod
    def parse(cls, text: str | dict) -> Recipe:
        """Check a recipe document; ValueError names the first broken rule."""
        doc = json.loads(text) if isinstance(text, str) else text
        if doc.get("recipeVersion") != 1:
            raise ValueError(f"unsupported recipeVersion: {doc.get('recipeVersion')}")
        box = doc["container"]
        if box.get("type") != "fixed_record":
            raise ValueError(f"unsupported container {box.get('type')!r}")
        header, record = int(box.get("headerSkipBytes", 0)), int(box["recordSizeBytes"])
        if record <= 0:
            raise ValueError(f"recordSizeBytes {record} is not positive")
        fields: dict[str, Field] = {}
        for f in doc["fields"]:
            if f["dtype"] not in DTYPES:
                raise ValueError(f"unknown dtype {f['dtype']!r}")
            made = Field(f["name"], int(f["offset"]), f["dtype"], f.get("endian", "le"), float(f.get("scale", 1.0)), float(f.get("valueOffset", 0.0)))
            end = made.offset + np.dtype(made.numpy).itemsize
            if end > record:
                raise ValueError(f"field {made.name} ends at byte {end}, past the record of {record}")
            fields.setdefault(made.name, made)

        def known(name: str, where: str) -> Field:
            if name not in fields:
                raise ValueError(f"{where} references unknown field {name!r}")
            return fields[name]

        channels = []
        for c in doc["channels"]:
            if not c.get("fields"):
                raise ValueError(f"channel {c['nativeId']} has no fields")
            channels.append((c["nativeId"], known(c["fields"][0], f"channel {c['nativeId']}")))
        time = doc["time"]
        return cls(header, record, known(time["field"], "time"), UNITS[time["unit"]], int(time.get("epochOffsetNs") or 0), tuple(channels))

    def decode(self, buf: bytes | memoryview) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Times and channel values of whole records; a trailing part is ignored."""
        n = len(buf) // self.record
        wanted = {f.name: f for f in (self.time, *(f for _, f in self.channels))}
        layout = np.dtype(
            {"names": list(wanted), "formats": [f.numpy for f in wanted.values()], "offsets": [f.offset for f in wanted.values()], "itemsize": self.record}
        )
        rec = np.frombuffer(buf, layout, count=n)
        values = {cid: rec[f.name].astype("f8") * f.scale + f.value_offset for cid, f in self.channels}
        return self._times(rec[self.time.name]), values

    def _times(self, raw: np.ndarray) -> np.ndarray:
        if raw.dtype.kind == "f":
            x = (raw.astype("f8") * self.time.scale + self.time.value_offset) * self.time_scale
            x = np.where(np.isnan(x), 0.0, np.trunc(x + np.copysign(0.5, x)))
            whole = np.where(x >= 2.0**63, _I64.max, np.where(x <= -(2.0**63), _I64.min, np.clip(x, -(2.0**62), 2.0**62).astype("i8")))
            return whole + self.time_offset
        raw = raw.astype("i8")
        top = _I64.max // self.time_scale
        scaled = np.where(raw > top, _I64.max, np.where(raw < -top, _I64.min, np.clip(raw, -top, top) * self.time_scale))
        off = self.time_offset
        if off >= 0:
            return np.where(scaled > _I64.max - off, _I64.max, np.minimum(scaled, _I64.max - off) + off)
        return np.where(scaled < _I64.min - off, _I64.min, np.maximum(scaled, _I64.min - off) + off)

    def batches(self, source_id: str, first_record: int, buf: bytes | memoryview) -> Iterator[pa.RecordBatch]:
        """One Arrow batch per channel of a run of records."""
        ts, values = self.decode(buf)
        n = len(ts)
        if not n:
            return
        seq = pa.array(np.arange(first_record, first_record + n, dtype="i8"))
        source = pa.array([source_id] * n, pa.string())
        for cid, v in values.items():
            yield pa.record_batch([source, pa.array([cid] * n, pa.string()), pa.array(ts), seq, pa.array(v)], schema=_ARROW)


CHUNK_RECORDS = 1 << 16


def recipe_splits(files: DataFrame, recipe: Recipe, split_bytes: int) -> DataFrame:
    """(path, first_record, records): runs of whole records of ``files(path, n_bytes)``."""
    per = max(1, split_bytes // recipe.record)
    total = F.expr(f"greatest(n_bytes - {recipe.header}, 0) div {recipe.record}")
    cut = files.select("path", total.alias("total")).filter("total > 0")
    cut = cut.select("path", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("total") - 1, F.lit(per).cast("bigint"))).alias("first_record"))
    return cut.select("path", "first_record", F.least(F.lit(per).cast("bigint"), F.col("total") - F.col("first_record")).alias("records"))


def read_recipe(spark: SparkSession, paths: Sequence[str] | str, recipe: str | dict, split_bytes: int = 128 << 20) -> DataFrame:
    """Samples of binary logs, files or folders; sizes come with the listing and splits are rows of a frame.

    A file shorter than its header has no records, and a part of a record at its end is left out.
    """
    text = recipe if isinstance(recipe, str) else json.dumps(recipe)
    plan = Recipe.parse(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Recipe.parse(text)
        for batch in batches:
            for split in batch.to_pylist():
                path = split["path"]
                fs, inner = located(path)
                with fs.open_input_file(inner) as f:
                    for at in range(split["first_record"], split["first_record"] + split["records"], CHUNK_RECORDS):
                        n = min(CHUNK_RECORDS, split["first_record"] + split["records"] - at)
                        yield from own.batches(path, at, f.read_at(n * own.record, own.header + at * own.record))

    splits = recipe_splits(list_files(spark, paths), plan, split_bytes)
    # Dealt out by number, as adaptive execution would merge these few small rows.
    return splits.repartition(task_count(spark), "path", "first_record").mapInArrow(run, SCHEMA)


def decode_blobs(blobs: DataFrame, recipe: str | dict) -> DataFrame:
    """Samples of ``blobs(source_id, first_record, data)``, runs of whole records."""
    text = recipe if isinstance(recipe, str) else json.dumps(recipe)
    Recipe.parse(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = Recipe.parse(text)
        for batch in batches:
            cols = batch.to_pydict()
            for source_id, first, data in zip(cols["source_id"], cols["first_record"], cols["data"]):
                yield from plan.batches(source_id, first, data)

    return blobs.select("source_id", F.col("first_record").cast("bigint").alias("first_record"), "data").mapInArrow(run, SCHEMA)


# -- quality profile -------------------------------------------------------------
def profile_channels(samples: DataFrame) -> DataFrame:
    """Per channel: count, minimum, maximum, NaN count and whether it is constant."""
    v = F.when(~F.isnan("value"), F.col("value"))
    lo, hi = F.min(v), F.max(v)
    known = lo.isNotNull() & (F.abs(lo) != float("inf"))
    low, high = F.when(known, lo).otherwise(0.0), F.when(known, hi).otherwise(0.0)
    return samples.groupBy("source_id", "channel_id").agg(
        F.count(F.lit(1)).alias("n_samples"),
        low.alias("min_value"),
        high.alias("max_value"),
        F.count_if(F.isnan("value")).alias("nan_count"),
        (F.abs(high - low) < 2.220446049250313e-16).alias("constant"),
    )


def profile_times(samples: DataFrame, files: DataFrame, header: int, record: int, target_rows: int | None = None) -> DataFrame:
    """Per source: records, range, order violations, median step and coverage.

    ``samples`` holds the rows of one channel per source, one per record, numbered by
    ``seq``; ``files(source_id, n_bytes)`` gives the sizes. Violations are counted in
    record order.
    """
    by = ["source_id"]
    rows = samples.select("source_id", "ts_ns", "seq")
    # seq is the record number: unique within a source, so it orders the scan alone.
    in_file = OrderedScan(rows, by, "seq", [], target_rows, F.lit(0), slice_bits=DENSE_BITS).lag("_p", F.col("ts_ns"))
    filed = in_file.run()
    largest = in_file.largest
    falls = F.count_if(F.col("ts_ns") < F.col("_p.v"))
    stats = filed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"), falls.alias("violations")
    )
    timed = OrderedScan(rows, by, target_rows=target_rows, at_most=largest).lag("_p", F.col("ts_ns")).run()
    steps = timed.filter(F.col("_p").isNotNull()).withColumn("_d", F.col("ts_ns") - F.col("_p.v"))
    median = ranked_pick(steps, by, "_d", {"median_delta_ns": (1, 2)}, target_rows, at_most=largest)
    size = F.col("n_bytes").cast("double")
    used = F.lit(header) + F.coalesce("records", F.lit(0)) * record
    covered = F.when((size > header) & (size > 0), used / size).otherwise(0.0)
    out = files.select("source_id", "n_bytes").join(stats, by, "left").join(median, by, "left")
    zero = F.lit(0).cast("bigint")
    return out.select(
        "source_id", F.coalesce("records", zero).alias("records"), "start_ns", "end_ns",
        F.coalesce("violations", zero).alias("violations"), F.coalesce("median_delta_ns", zero).alias("median_delta_ns"), covered.alias("coverage"),
    )


def gate_profile(times: DataFrame, channels: DataFrame, relax_monotonicity: bool = False, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Whether each source passes, and why not."""
    varies = channels.groupBy("source_id").agg(F.bool_or(~F.col("constant")).alias("_varies"))
    joined = times.join(varies, "source_id", "left")
    unordered = F.lit(False) if relax_monotonicity else F.col("violations") > 0
    reasons = F.array_compact(
        F.array(
            F.when(F.col("coverage") < min_coverage, F.lit("coverage is too low")),
            F.when(unordered, F.lit("time is not monotonic")),
            F.when(~F.coalesce("_varies", F.lit(False)), F.lit("no channel ever changes")),
        )
    )
    return joined.select("source_id", (F.size(reasons) == 0).alias("accepted"), reasons.alias("reasons"))


# -- matching --------------------------------------------------------------------
def magic_bytes(recipes: DataFrame) -> DataFrame:
    """``n_bytes``: how much of each file's head the magics of ``recipes`` reach."""
    reach = F.transform("magics", lambda m: m["offset"] + F.ceil(F.length(F.regexp_replace(m["hex"], r"\s", "")) / 2))
    return recipes.select(F.coalesce(F.max(F.array_max(reach)), F.lit(0)).cast("int").alias("n_bytes"))


def match_recipes(files: DataFrame, recipes: DataFrame) -> DataFrame:
    """The recipe of each file: all magic bytes match, else the extension; newest first.

    ``files(path, name, head BINARY)``, ``recipes(recipe_id, ord, extensions, magics
    ARRAY<STRUCT<offset INT, hex STRING>>)`` with the newest at the lowest ``ord``; heads
    reach as far as :func:`magic_bytes` says, and where ``files`` has ``n_bytes``, the sizes of the
    files, a shorter head is an error. Both tests are equality joins, whatever the
    number of rules: on the bytes at each offset in use, and on name suffixes of each length
    in use. Offsets and lengths in use are lists in one value.
    """
    rules = recipes.withColumn("magics", F.transform("magics", lambda m: F.struct(m["offset"].alias("offset"), F.upper(F.regexp_replace(m["hex"], r"\s", "")).alias("hex"))))
    head = F.col("head")
    if "n_bytes" in files.columns:
        reach = magic_bytes(recipes).first()["n_bytes"]
        short = F.coalesce(F.length("head"), F.lit(0)) < F.least("n_bytes", F.lit(reach))
        head = F.when(short, F.raise_error(F.concat(F.lit(f"head is shorter than the {reach} bytes of the magics: "), "path")).cast("binary")).otherwise(head)
    prepared = files.withColumns({"_hex": F.hex(head), "_lower": F.lower("name")})
    magic_rules = rules.filter(F.size("magics") > 0).select("recipe_id", "ord", "magics", F.get("magics", F.lit(0)).alias("_m"))
    magic_rules = magic_rules.filter(F.forall("magics", lambda m: m["hex"].rlike("^([0-9A-F]{2})*$")))
    magic_rules = magic_rules.withColumn("_spot", F.struct(F.col("_m.offset").alias("o"), F.length("_m.hex").alias("n"))).withColumn("_want", F.col("_m.hex"))
    ext_rules = rules.select("recipe_id", "ord", F.explode("extensions").alias("_e")).select("recipe_id", "ord", F.lower("_e").alias("_suffix"))
    spots = magic_rules.agg(F.collect_set("_spot")).scalar()
    lengths = ext_rules.agg(F.collect_set(F.length("_suffix"))).scalar()
    looked = prepared.select("path", "_hex", F.explode(spots).alias("_spot")).withColumn("_want", F.substr("_hex", F.col("_spot.o") * 2 + 1, F.col("_spot.n")))
    found = looked.join(magic_rules.drop("_m"), ["_spot", "_want"])
    whole = F.forall("magics", lambda m: F.substr("_hex", m["offset"] * 2 + 1, F.length(m["hex"])) == m["hex"])
    hits = [found.filter(whole).select("path", "recipe_id", F.struct(F.lit(0).alias("r"), F.col("ord").alias("o")).alias("_place"), F.lit("magic").alias("matched_by"))]
    tails = prepared.withColumn("_lengths", lengths)
    tails = tails.select("path", F.explode(F.array_distinct(F.transform("_lengths", lambda n: F.right("_lower", n)))).alias("_suffix"))
    hits.append(tails.join(ext_rules, "_suffix").select("path", "recipe_id", F.struct(F.lit(1).alias("r"), F.col("ord").alias("o")).alias("_place"), F.lit("extension").alias("matched_by")))
    options = hits[0].unionByName(hits[1])
    best = options.groupBy("path").agg(F.min_by(F.struct("recipe_id", "matched_by"), "_place").alias("b"))
    return files.select("path").join(best, "path", "left").select("path", "b.*")
