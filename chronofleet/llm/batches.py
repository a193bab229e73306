"""Documents packed in batches that ask the corpus about their keys.

A batch is one row of a written table: ids and compressed texts of some thousand documents. It
sends every distinct key once to the key's bucket, with how often it has it, and gets an answer
per key back. What a bucket holds of a key grows with the number of batches, never with the
number of documents, so a key that a third of all documents share makes no hot task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofleet.llm.common import saved_by, strings

BATCH_BYTES = 6 << 20
PACKED = "batch long, ids binary, offsets binary, data binary"


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def packed(docs: DataFrame, extra: Callable[[np.ndarray, np.ndarray], dict[str, bytes]] | None = None, extra_schema: str = "", tagged: bool = False, batch_bytes: int | None = None) -> DataFrame:
    """(batch, ids, offsets, data, ...) written once in buckets; rows without an id are left out.

    ``docs`` has doc_id and text, and a string column tag if ``tagged``. ``extra`` maps a batch's bytes
    and offsets to further columns.
    """
    limit = batch_bytes or BATCH_BYTES
    if tagged:
        extra_schema = ", ".join(x for x in (extra_schema, "tags binary") if x)
    names = [c.split()[0] for c in extra_schema.split(", ") if c]

    def task(batches: Iterator[pa.RecordBatch]):
        squeeze = zstandard.ZstdCompressor(level=5)
        ids, bufs, sizes, tags, held, count, part = [], [], [], [], 0, 0, 0

        def flush():
            buf = np.concatenate(bufs)
            offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int64)
            more = extra(buf, offs) if extra else {}
            if tagged:
                more["tags"] = json.dumps(tags).encode()
            row = [part << 24 | count, _bytes(np.concatenate(ids)), _bytes(offs), squeeze.compress(buf)] + [more[n] for n in names]
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64())] + [pa.array([x], pa.binary()) for x in row[1:]], ["batch", "ids", "offsets", "data", *names])

        for b in batches:
            if b.num_rows == 0:
                continue
            part = b.column("part")[0].as_py()
            own = b.column("doc_id").to_numpy(zero_copy_only=False)
            buf, offs = strings(b.column("text"))
            own_tags = b.column("tag").to_pylist() if tagged else []
            at = 0
            while at < len(own):
                to = int(np.searchsorted(offs, offs[at] + limit - held, "right")) - 1
                to = min(max(to, at + 1), len(own))
                ids.append(own[at:to])
                bufs.append(buf[offs[at] : offs[to]].copy())
                sizes.append(np.diff(offs[at : to + 1]))
                tags += own_tags[at:to]
                held += int(offs[to] - offs[at])
                at = to
                if held >= limit * 0.98 or at < len(own):
                    yield flush()
                    ids, bufs, sizes, tags, held, count = [], [], [], [], 0, count + 1
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.spark_partition_id().cast("long").alias("part"), *(["tag"] if tagged else []))
    rows = rows.filter("doc_id IS NOT NULL").mapInArrow(task, PACKED + (", " + extra_schema if extra_schema else ""))
    return saved_by(rows, "batch")


def unpacked(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, bytes and offsets of a batch row."""
    offs = np.frombuffer(row["offsets"], np.int64)
    data = zstandard.ZstdDecompressor().decompress(row["data"], max_output_size=int(offs[-1])) if offs[-1] else b""
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(data, np.uint8), offs


def tags_of(row) -> list[str | None]:
    return json.loads(row["tags"])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield {n: b.column(n)[i].as_py() for n in b.schema.names}


#: Keys keep this many of their 64 bits on the way.
KEY_BITS = 48


def encoded(keys: np.ndarray) -> bytes:
    """Sorted KEY_BITS-bit keys: steps of their high half, of as few bytes as do, and the low 16 bits."""
    steps = np.diff(keys >> np.uint64(16), prepend=np.uint64(0)).astype(np.uint32)
    most = int(steps[1:].max(initial=0))
    width = 2 if most < 1 << 16 else 3 if most < 1 << 24 else 4
    planes = np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 4)[:, :width].T)
    return bytes([width]) + steps[:1].tobytes() + planes.tobytes() + (keys & np.uint64(0xFFFF)).astype(np.uint16).tobytes()


def decoded(blob: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.uint64)
    width = blob[0]
    steps = np.zeros((n, 4), np.uint8)
    steps[0] = np.frombuffer(blob, np.uint8, 4, 1)
    steps[1:, :width] = np.frombuffer(blob, np.uint8, width * (n - 1), 5).reshape(width, -1).T
    high = np.cumsum(steps.view(np.uint32).ravel(), dtype=np.uint64)
    return high << np.uint64(16) | np.frombuffer(blob, np.uint16, n, 5 + width * (n - 1))


ASKED = "bucket int, batch long, n int, keys binary, counts binary"
ANSWERED = "batch long, bucket int, answers binary"


def cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Borders of the buckets, equal ranges of the key space, in sorted keys."""
    edges = (np.arange(buckets + 1, dtype=object) * (1 << KEY_BITS)) // buckets
    return np.searchsorted(keys, np.array([int(e) for e in edges[:-1]], np.uint64)).tolist() + [len(keys)]


def asked(batch: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> pa.RecordBatch:
    """The questions of a batch: its sorted distinct keys by bucket with their counts, 255 at most."""
    at = cuts(keys, buckets)
    where = [i for i in range(buckets) if at[i + 1] > at[i]]
    small = np.minimum(counts, 255).astype(np.uint8)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(where, pa.int32()), pa.array([batch] * len(where), pa.int64()), pa.array([at[i + 1] - at[i] for i in where], pa.int32()),
            pa.array([encoded(keys[at[i] : at[i + 1]]) for i in where], pa.binary()), pa.array([small[at[i] : at[i + 1]].tobytes() for i in where], pa.binary()),
        ],
        ["bucket", "batch", "n", "keys", "counts"],
    )


def frequency_classes(pdf: pd.DataFrame) -> pd.DataFrame:
    """Answers of a bucket: per key 0 if one document has it, else 1 + the binary order of how many."""
    n = pdf["n"].to_numpy()
    keys = np.concatenate([decoded(k, m) for k, m in zip(pdf["keys"], n)])
    counts = np.concatenate([np.frombuffer(c, np.uint8) for c in pdf["counts"]]).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    at = np.flatnonzero(new)
    total = np.add.reduceat(counts[order], at)
    kind = np.where(total > 1, np.floor(np.log2(total)) + 1, 0).astype(np.uint8)
    answer = np.empty(len(keys), np.uint8)
    answer[order] = np.repeat(kind, np.diff(np.append(at, len(keys))))
    ends = np.cumsum(n)
    return pd.DataFrame({"batch": pdf["batch"], "bucket": pdf["bucket"], "answers": [answer[e - m : e].tobytes() for e, m in zip(ends, n)]})


def in_order(answers: pd.DataFrame) -> np.ndarray:
    """All answers a batch got, in the order of its sorted keys."""
    if len(answers) == 0:
        return np.zeros(0, np.uint8)
    return np.frombuffer(b"".join(answers.sort_values("bucket")["answers"]), np.uint8)
