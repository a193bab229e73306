"""Exact deduplication by tree-merging sorted digest runs.

Each task turns its rows into sorted runs, one per digest range (shard). Runs are exchanged
in binomial rounds, ``2 ** ROUNDS_AT_ONCE`` of them per exchange: a multiway merge of the runs
of one parent keeps, for equal digests, the smallest identifier by the order of the rule and
the number of rows. A merge compares all 256 bits, never only the sort key. A level holds one
entry per digest and run, so a group of copies of any size shrinks to one entry per task
before the first exchange.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofleet.llm.common import ready, saved, shuffle_partitions, table

ROUNDS_AT_ONCE = 4
RUN_ROWS = 1 << 20
SHARD_ROWS = 1 << 19
#: Characters that do not count, as text equality is defined.
SPACES = " \t\n\x0b\f\r"

_ENTRY = np.dtype([("d", ">u8", 4), ("short", "<i8"), ("none", "u1"), ("id", "<i8"), ("rows", "<i8")])
_RUN = "shard int, run long, entries binary"


def _merged(e: np.ndarray) -> np.ndarray:
    """Entries of one or more runs as one sorted run with one entry per digest."""
    if len(e) == 0:
        return e
    d = e["d"]
    e = e[np.lexsort((e["id"], e["none"], e["short"], d[:, 3], d[:, 2], d[:, 1], d[:, 0]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["d"][1:] != e["d"][:-1]).any(axis=1)
    at = np.flatnonzero(new)
    out = e[at].copy()
    out["rows"] = np.add.reduceat(e["rows"], at)
    return out


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_points, text_sha256) per row; JVM-side."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.char_length(body).cast("long").alias("n_points"),
        F.sha2(F.translate(body, SPACES, "").cast("binary"), 256).alias("text_sha256"),
    )


def _runs(shards: int):
    """Sorted runs of a task: one per shard, more if a task holds over RUN_ROWS rows."""

    def task(batches):
        held, n, part = [], 0, 0

        def flushed(k):
            e = _merged(np.concatenate(held))
            shard = ((e["d"][:, 0] >> np.uint64(32)).astype(np.int64) * shards) >> 32
            cut = np.searchsorted(shard, np.arange(shards + 1))
            rows = [(s, e[a:b].tobytes()) for s, (a, b) in enumerate(zip(cut[:-1], cut[1:])) if b > a]
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([k] * len(rows), pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                ["shard", "run", "entries"],
            )

        for b in batches:
            if b.num_rows == 0:
                continue
            e = np.zeros(b.num_rows, _ENTRY)
            e["d"] = np.frombuffer(bytes.fromhex("".join(b.column("text_sha256").to_pylist())), ">u8").reshape(-1, 4)
            e["short"] = -b.column("n_points").to_numpy(zero_copy_only=False)
            ids = b.column("doc_id")
            e["none"] = ids.is_null().to_numpy(zero_copy_only=False)
            e["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)
            e["rows"] = 1
            task_id = b.column("task")[0].as_py()
            held.append(e)
            n += len(e)
            if n >= RUN_ROWS:
                yield flushed(task_id + part * (1 << 24))
                held, n, part = [], 0, part + 1
        if held:
            yield flushed(task_id + part * (1 << 24))

    return task


def _merge_group(pdf: pd.DataFrame) -> pd.DataFrame:
    e = _merged(np.concatenate([np.frombuffer(x, _ENTRY) for x in pdf["entries"]]))
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "run": [pdf["run"].iloc[0]], "entries": [e.tobytes()]})


def _rows(batches):
    for b in batches:
        for blob in b.column("entries"):
            e = np.frombuffer(blob.as_py(), _ENTRY)
            hexes = np.ascontiguousarray(e["d"]).tobytes().hex()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([hexes[i : i + 64] for i in range(0, len(hexes), 64)], pa.string()),
                    pa.array(np.ascontiguousarray(e["id"]), pa.int64(), mask=e["none"].astype(bool)),
                    pa.array(np.ascontiguousarray(e["rows"]), pa.int64()),
                ],
                ["text_sha256", "keep_id", "group_size"],
            )


def winners(keys: DataFrame) -> DataFrame:
    """(text_sha256, keep_id, group_size) per distinct digest of ``keys``."""
    spark = keys.sparkSession
    shards = ready(shuffle_partitions(spark), keys.count(), SHARD_ROWS)
    runs = saved(keys.withColumn("task", F.spark_partition_id().cast("long")).mapInArrow(_runs(shards), _RUN))
    top = runs.agg(F.max("run")).first()[0] or 0
    while True:
        runs = runs.withColumn("run", F.shiftright("run", ROUNDS_AT_ONCE)).groupBy("shard", "run").applyInPandas(_merge_group, _RUN)
        top >>= ROUNDS_AT_ONCE
        if top == 0:
            return runs.mapInArrow(_rows, "text_sha256 string, keep_id long, group_size long")


def exact_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are so without the characters of SPACES. Of equal texts the row
    with the most code points stays, then the smallest id. Null text counts as empty, a row
    without an id is kept only where no row of its group has one, and rows that repeat an id
    and its text count each and are kept together. An empty table gives an empty table.
    """
    keys = saved(digests(docs, doc_id, text))
    out = keys.join(winners(keys), "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay, with all their columns; of repeated rows, one."""
    best = exact_duplicates(docs).filter("kept").select(F.col("doc_id").alias("_keep"), F.col("text_sha256").alias("_digest")).distinct()
    body = F.sha2(F.translate(F.coalesce("text", F.lit("")), SPACES, "").cast("binary"), 256)
    return docs.join(best, docs["doc_id"].eqNullSafe(best["_keep"]) & (body == best["_digest"]), "left_semi")


def query(spark, sf_dir):
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM w
"""
