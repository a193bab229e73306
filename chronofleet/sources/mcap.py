"""Message rows of MCAP containers.

Files are a frame. Tasks read the chunk index at a file's end, one row per chunk, which is
filtered like any frame: by time, by topic. Chunks that lie within the same PACK_BYTES of a file
make one unit of work, whatever their number; a unit is read chunk by chunk. A file without a
chunk index is cut into byte ranges. A task finds the first record of its range by the chain of
records that must follow it; where the range before ends elsewhere it is walked again from there.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronofleet.sources.files import list_files, located, task_count

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the container format: magic, record opcodes, trailing sizes.
MAGIC = b"\x89MCAP0\r\n"
FOOTER, SCHEMA, CHANNEL, MESSAGE, CHUNK, CHUNK_INDEX, DATA_END = 0x02, 0x03, 0x04, 0x05, 0x06, 0x08, 0x0F
FOOTER_BYTES = 9 + 20
MESSAGE_HEADER = 22

SCHEMA_DDL = "source_id string, topic string, schema_name string, encoding string, log_time bigint, seq bigint, payload binary"
_ARROW = pa.schema(
    [("source_id", pa.string()), ("topic", pa.string()), ("schema_name", pa.string()), ("encoding", pa.string()), ("log_time", pa.int64()), ("seq", pa.int64()), ("payload", pa.binary())]
)
INDEX_DDL = "path string, ordinal bigint, offset bigint, length bigint, first_time bigint, last_time bigint, topics array<string>, chunked boolean"
PACK_BYTES = 128 << 20
BATCH_BYTES = READ_BYTES = 8 << 20
#: Records that must follow one another where a range is thought to begin.
FOLLOWERS = 16


class _Cursor:
    """Little-endian fields of one record."""

    def __init__(self, buf: memoryview):
        self.buf, self.at = buf, 0

    def take(self, fmt: str) -> tuple:
        out = struct.unpack_from("<" + fmt, self.buf, self.at)
        self.at += struct.calcsize("<" + fmt)
        return out

    def text(self) -> str:
        (n,) = self.take("I")
        self.at += n
        return bytes(self.buf[self.at - n : self.at]).decode()


def _records(buf: memoryview) -> Iterator[tuple[int, memoryview]]:
    at = 0
    while at + 9 <= len(buf):
        op, n = struct.unpack_from("<BQ", buf, at)
        if at + 9 + n > len(buf):
            return
        yield op, buf[at + 9 : at + 9 + n]
        at += 9 + n


@dataclass
class _Names:
    """Schemas and channels seen so far."""

    schemas: dict[int, tuple[str, str]] = field(default_factory=dict)
    channels: dict[int, tuple[str, int]] = field(default_factory=dict)

    def learn(self, op: int, body: memoryview) -> None:
        c = _Cursor(body)
        if op == SCHEMA:
            (sid,) = c.take("H")
            self.schemas[sid] = (c.text(), c.text())
        elif op == CHANNEL:
            cid, sid = c.take("HH")
            self.channels[cid] = (c.text(), sid)

    def topic(self, cid: int) -> tuple[str, str, str]:
        topic, sid = self.channels.get(cid, ("", 0))
        return topic, *self.schemas.get(sid, ("", ""))


def _open(path: str):
    fs, inner = located(path)
    return fs.open_input_file(inner)


def _summary(f, path: str) -> tuple[_Names, list[tuple], int]:
    """Names and (first, last, offset, length, channel ids) per chunk of a file, and where its data ends."""
    size = f.size()
    if size < len(MAGIC) or f.read_at(len(MAGIC), 0) != MAGIC:
        raise ValueError(f"{path} is not an MCAP file")
    names, chunks = _Names(), []
    if size < FOOTER_BYTES + 2 * len(MAGIC):
        raise ValueError(f"{path} has no footer: it is cut or damaged")
    tail = f.read_at(FOOTER_BYTES + len(MAGIC), size - FOOTER_BYTES - len(MAGIC))
    op, _, summary_start = struct.unpack_from("<BQQ", tail, 0)
    if op != FOOTER or tail[-len(MAGIC) :] != MAGIC:
        raise ValueError(f"{path} has no footer: it is cut or damaged")
    data_end = size - FOOTER_BYTES - len(MAGIC)
    if summary_start:
        for kind, body in _records(memoryview(f.read_at(data_end - summary_start, summary_start))):
            names.learn(kind, body)
            if kind == CHUNK_INDEX:
                c = _Cursor(body)
                first, last, offset, length, index_bytes = c.take("QQQQI")
                chunks.append((first, last, offset, length, [c.take("HQ")[0] for _ in range(index_bytes // 10)]))
        data_end = summary_start
    return names, sorted(chunks, key=lambda c: c[2]), data_end


def chunk_index(files: DataFrame, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """One row per chunk of ``files(path)``; per ``pack_bytes`` of a file that has no chunk index.

    ``topics`` is empty where it is unknown; such a row may hold any topic and any time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with _open(path) as f:
                    names, chunks, data_end = _summary(f, path)
                rows = [(path, i, c[2], c[3], c[0], c[1], sorted({names.topic(x)[0] for x in c[4]}), True) for i, c in enumerate(chunks)]
                if not chunks:
                    cuts = [*range(len(MAGIC), data_end, pack_bytes), data_end]
                    rows = [(path, i, a, b - a, -(2**63), 2**63 - 1, [], False) for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))]
                if rows:
                    types = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.string()), pa.bool_()]
                    yield pa.RecordBatch.from_arrays([pa.array(col, t) for col, t in zip(zip(*rows), types)], [c.split()[0] for c in INDEX_DDL.split(", ")])

    return files.select("path").mapInArrow(run, INDEX_DDL)


# -- files without an index ------------------------------------------------------
def _starts(buf: np.ndarray) -> np.ndarray:
    """Where a record may begin: a known or private opcode and a length that fits."""
    if len(buf) < 9:
        return np.zeros(0, np.int64)
    op = buf[: len(buf) - 8]
    high = np.zeros(len(op), bool)
    for k in range(6, 9):  # lengths below 2 ** 40
        high |= buf[k : len(op) + k] != 0
    at = np.flatnonzero(((op >= 1) & (op <= DATA_END) | (op >= 0x80)) & ~high)
    return at


def _span(f, start: int, stop: int, data_end: int) -> tuple[int, int, _Names]:
    """From a record at ``start``: where the first one at or behind ``stop`` begins, the messages before it, their names."""
    names, messages, at, buf, base = _Names(), 0, start, b"", start
    while at < stop:
        if at + 9 > base + len(buf):
            buf, base = f.read_at(min(READ_BYTES, data_end - at), at), at
        if len(buf) - (at - base) < 9:
            raise ValueError("records end in the middle: the file is cut or damaged")
        op, n = struct.unpack_from("<BQ", buf, at - base)
        if not (1 <= op <= DATA_END or op >= 0x80) or at + 9 + n > data_end or op == MESSAGE and n < MESSAGE_HEADER:
            raise ValueError("no record where one must be: the file is cut or damaged")
        if op == MESSAGE:
            messages += 1
        elif op in (SCHEMA, CHANNEL, CHUNK):
            messages += sum(1 for _ in _messages(memoryview(f.read_at(9 + n, at)), names))
        at += 9 + n
        if op == DATA_END:
            if at < data_end:
                raise ValueError("data behind its end: the file is damaged")
            break
    return at, messages, names


def _followed(f, at: int, data_end: int) -> bool:
    """Whether a chain of FOLLOWERS records begins at ``at``, or one that ends the data."""
    for _ in range(FOLLOWERS):
        if at == data_end:
            return True
        if at + 9 > data_end:
            return False
        op, n = struct.unpack("<BQ", f.read_at(9, at))
        if not (1 <= op <= DATA_END or op >= 0x80) or at + 9 + n > data_end or op == MESSAGE and n < MESSAGE_HEADER:
            return False
        at += 9 + n
        if op == DATA_END:
            return at == data_end
    return True


def _walk(f, offset: int, length: int, data_end: int) -> tuple | None:
    """The first record that seems to begin in a range, and what :func:`_span` says from there on."""
    if offset == len(MAGIC):
        return offset, *_span(f, offset, offset + length, data_end)
    for base in range(offset, offset + length, READ_BYTES):
        buf = np.frombuffer(f.read_at(min(READ_BYTES + 8, data_end - base), base), np.uint8)
        for at in _starts(buf):
            at = base + int(at)
            if at >= min(offset + length, base + READ_BYTES):
                break
            if _followed(f, at, data_end):
                try:
                    return at, *_span(f, at, offset + length, data_end)
                except ValueError:
                    continue
    return None


def _dump(names: _Names) -> bytes:
    return cloudpickle.dumps((names.schemas, names.channels))


RANGE_DDL = "path string, start bigint, end bigint, data_end bigint, messages bigint, names binary"
_RANGE = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("data_end", pa.int64()), ("messages", pa.int64()), ("names", pa.binary())])


def _ranges(index: DataFrame) -> DataFrame:
    """Ranges of files without an index as they seem: how many messages and which names each has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.select(["path", "offset", "length"]).to_pylist():
                with _open(row["path"]) as f:
                    data_end = _summary(f, row["path"])[2]
                    found = _walk(f, row["offset"], row["length"], data_end)
                if found is not None:
                    yield pa.RecordBatch.from_pylist([dict(zip(_RANGE.names, (row["path"], found[0], found[1], data_end, found[2], _dump(found[3]))))], _RANGE)

    return index.mapInArrow(run, RANGE_DDL)


def _settled(pdf: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file as they are, numbered.

    The first range begins with the file's records, so its end is right; a range that begins there is
    right too, and so on. One that does not meet the range before it was led astray by bytes that look
    like records; it is walked again from where the range before it ends.
    """
    path, data_end = pdf["path"].iloc[0], int(pdf["data_end"].iloc[0])
    out, at, count = [], len(MAGIC), 0
    with _open(path) as f:

        def again(stop: int) -> None:
            nonlocal at, count
            end, messages, names = _span(f, at, stop, data_end)
            out.append((path, at, end, count, _dump(names)))
            at, count = end, count + messages

        for r in pdf.sort_values("start").itertuples():
            if r.start > at:
                again(int(r.start))
            if r.start == at:
                out.append((path, at, int(r.end), count, r.names))
                at, count = int(r.end), count + int(r.messages)
            elif r.end > at:
                again(int(r.end))
        if at < data_end:
            again(data_end)
    return pd.DataFrame(out, columns=["path", "start", "end", "first", "names"])


def _units(index: DataFrame, pack_bytes: int) -> DataFrame:
    """(path, pieces, names): what is read together. Pieces are (start, end, first number)."""
    tasks = task_count(index.sparkSession)
    packed = index.filter("chunked").withColumn("pack", F.expr(f"`offset` div {pack_bytes}")).repartition(tasks, "path", "pack")
    piece = F.struct(F.col("offset").alias("start"), (F.col("offset") + F.col("length")).alias("end"), F.shiftleft("ordinal", 32).alias("first"))
    chunks = packed.groupBy("path", "pack").agg(F.sort_array(F.collect_list(piece)).alias("pieces")).select("path", "pieces", F.lit(None).cast("array<binary>").alias("names"))
    ranges = _ranges(index.filter("NOT chunked").repartition(tasks, "path", "offset"))
    ranges = ranges.groupBy("path").applyInPandas(_settled, "path string, start bigint, end bigint, first bigint, names binary")
    names = F.collect_list("names").over(Window.partitionBy("path"))
    numbered = ranges.select("path", F.array(F.struct("start", "end", "first")).alias("pieces"), names.alias("names"))
    # What is read is dealt out by number: adaptive execution would merge these few small rows.
    return chunks.unionByName(numbered.repartition(tasks, "path", F.col("pieces")[0]["start"]))


def _read_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for unit in batch.to_pylist():
            with _open(unit["path"]) as f:
                names, _, _ = _summary(f, unit["path"])
                for blob in unit["names"] or []:
                    schemas, channels = cloudpickle.loads(blob)
                    names.schemas |= schemas
                    names.channels |= channels
                rows, held = [], 0
                for p in unit["pieces"]:
                    raw = memoryview(f.read_at(p["end"] - p["start"], p["start"]))
                    for n, (cid, log_time, data) in enumerate(_messages(raw, names)):
                        rows.append((unit["path"], *names.topic(cid), log_time, p["first"] + n, data))
                        held += len(data) + 64
                        if held >= BATCH_BYTES:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)


def _messages(raw: memoryview, names: _Names) -> Iterator[tuple[int, int, bytes]]:
    for op, body in _records(raw):
        if op == CHUNK:
            c = _Cursor(body)
            _, _, size, _ = c.take("QQQI")
            codec = c.text()
            (n,) = c.take("Q")
            inner = body[c.at : c.at + n]
            if codec == "zstd":
                inner = memoryview(pa.Codec("zstd").decompress(pa.py_buffer(inner), size))
            elif codec:
                raise ValueError(f"unsupported chunk compression {codec!r}")
            yield from _messages(inner, names)
        elif op == MESSAGE:
            cid, _, log_time, _ = struct.unpack_from("<HIQQ", body, 0)
            yield cid, log_time, bytes(body[MESSAGE_HEADER:])
        else:
            names.learn(op, body)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(col, t.type) for col, t in zip(zip(*rows), _ARROW)], schema=_ARROW)


def read_mcap(
    spark: SparkSession, paths: Sequence[str] | str, start_ns: int | None = None, end_ns: int | None = None, topics: Sequence[str] | None = None, pack_bytes: int = PACK_BYTES
) -> DataFrame:
    """Messages of MCAP files and folders with ``start_ns <= log_time < end_ns`` of the wanted topics.

    Chunks that can't hold any are not read. ``seq`` orders the messages of a file. A file whose
    records end in the middle is an error.
    """
    index = chunk_index(list_files(spark, paths), pack_bytes)
    keep = F.lit(True)
    if start_ns is not None:
        index, keep = index.filter(F.col("last_time") >= start_ns), keep & (F.col("log_time") >= start_ns)
    if end_ns is not None:
        index, keep = index.filter(F.col("first_time") < end_ns), keep & (F.col("log_time") < end_ns)
    if topics is not None:
        wanted = F.array(*[F.lit(t) for t in topics])
        index = index.filter((F.size("topics") == 0) | F.arrays_overlap("topics", wanted))
        keep = keep & F.col("topic").isin(*topics)
    return _units(index, pack_bytes).mapInArrow(_read_units, SCHEMA_DDL).filter(keep)
