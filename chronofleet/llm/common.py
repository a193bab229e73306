"""Helpers of this package: tables, shared scratch folder, bounded text pieces, rolling hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text a task works on at a time; a longer document is a piece of its own.
PIECE_BYTES = 1 << 20


def reachable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they have it there."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (env.get("PYTHONPATH"), root) if x)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Scratch paths handed out and not yet dropped, and the folder that stands in for one that isn't set.
_handed_out: list[str] = []
_stand_in: list[str] = []


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of ``spark.checkpoint.dir``.

    Where that setting is absent a temporary folder takes its place, which is possible on one machine
    only: on a cluster its absence is an error.
    """
    reachable(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _stand_in:
            _stand_in.append(tempfile.mkdtemp(prefix="llm-scratch-"))
        base = _stand_in[0]
    _handed_out.append(f"{base.rstrip('/')}/{uuid.uuid4().hex}")
    return _handed_out[-1]


def scratch_mark() -> int:
    """How many scratch paths have been handed out; those after it belong to what runs next."""
    return len(_handed_out)


def drop_scratch(keep: DataFrame, since: int) -> None:
    """Deletes the scratch tables handed out after the mark ``since`` but for those that ``keep``, a saved frame, reads."""
    spark, files = keep.sparkSession, keep.inputFiles()
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for path in _handed_out[since:]:
        if not any(path.rsplit("/", 1)[-1] in f for f in files):
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _handed_out.remove(path)


def saved(df: DataFrame) -> DataFrame:
    """``df`` as a written table: cuts the lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, key: str) -> DataFrame:
    """Like ``saved``, in buckets by ``key``: joins and groups by it later need no shuffle of ``df``."""
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    df.write.bucketBy(shuffle_partitions(spark), key).option("path", scratch(spark)).saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name; the files of an external table stay
    return out


def ready(parts: int, n: int, per: int) -> int:
    """Partitions for ``n`` items at ``per`` each, but no fewer than ``parts``."""
    return max(parts, -(-n // per), 1)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(size)
    at = 0
    while at < batch.num_rows:
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right"))
        to = min(max(to, at + 1), batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


# Rolling hash modulo 2^64: every substring of a buffer has a hash that does not depend on
# where it stands. The multiplier is 3 modulo 8, which keeps periodic texts apart.
_STEP = np.uint64(0x9E3779B97F4A7C13)
_BACK = np.uint64(pow(int(_STEP), -1, 1 << 64))
_BYTE = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + (1 << 16))
        up = np.full(size, _STEP, np.uint64)
        down = np.full(size, _BACK, np.uint64)
        up[0] = down[0] = 1
        _powers[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any substring of a buffer from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _power_tables(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * up[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mixed(raw + (end - start).astype(np.uint64))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def lowered(buf: np.ndarray) -> np.ndarray:
    """A-Z as a-z; every other byte stays."""
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and the row of each."""
    solid = ~_SPACE[buf]
    if not solid.any():
        none = np.zeros(0, np.int64)
        return none, none, none
    first = np.zeros(len(buf) + 1, bool)
    first[offs] = True  # a new row ends the word before it
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | first[:-1]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def word_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of ``n`` rows begin and end in the list of all words."""
    return np.searchsorted(rows, np.arange(n + 1))
