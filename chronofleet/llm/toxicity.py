"""Toxicity scores by FTRL-proximal logistic regression over hashed n-grams and skip-grams.

A document is the set of its words, word pairs, pairs with one word between and beginnings of
words, told apart by how often they occur, hashed to ``1 << BITS`` coordinates. FTRL keeps per
coordinate the sum of squared gradients, hence a rate of its own, and its L1 term holds rare or
uninformative coordinates at exactly 0. A round is one job: shards of labelled documents sum
their gradients at common weights, so the result does not depend on order or partitioning.
The state has at most ``1 << BITS`` rows, which bounds what the driver holds and what is
broadcast; the final weights keep the coordinates that aren't 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofleet.llm.common import Rolling, lowered, mixed, pieces, saved, saved_by, strings, table, words

BITS = 20
#: Bytes of the beginnings of words, and the counts told apart.
STEMS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 4)
#: Documents with a label that training uses at most: those of the smallest hash.
TRAIN_ROWS = 1 << 15
#: Bytes of text that are taken apart at a time; a longer document is taken alone.
PIECE_BYTES = 1 << 18
SHARDS = 24
ROUNDS = 24
ALPHA, BETA, L1 = 0.2, 1.0, 0.2
#: The L1 penalty of a coordinate: standard deviations of its gradient, as for scaled inputs.
DEVIATIONS = 2.5
#: Share of its penalty that a coordinate's first gradient must exceed, and its documents.
SCREEN, LEAST_DOCS = 0.7, 1
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
BIAS = 1 << BITS

_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_APART = np.arange(256, dtype=np.uint8)
_APART[[c for c in range(128) if not chr(c).isalnum()]] = 32


def coordinates(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, coordinate) of every word, pair, skip-pair and beginning of a longer word.

    Words are runs of letters and digits. Beginnings let a stem count in all its forms.
    """
    buf = _APART[lowered(buf)]
    start, end, row = words(buf, offs)
    hashes = Rolling(buf)
    h = hashes.of(start, end)
    shift = np.uint64(64 - BITS)
    rows, out = [row], [mixed(h) >> shift]
    for gap, a, b in ((1, _A, _B), (2, _C, _D)):
        same = row[gap:] == row[:-gap]
        rows.append(row[gap:][same])
        out.append(mixed(h[:-gap][same] * a + h[gap:][same] * b) >> shift)
    for k in STEMS:
        longer = end - start > k
        rows.append(row[longer])
        out.append(mixed(hashes.of(start[longer], start[longer] + k) * _A) >> shift)
    return np.concatenate(rows), np.concatenate(out).astype(np.int64)


def _leveled(at: np.ndarray, level: int) -> np.ndarray:
    """The coordinate that tells that ``at`` occurs at least ``level`` times."""
    return (at * 0x9E3779B1 + level * 0x85EBCA77) & ((1 << BITS) - 1)


def features(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, coordinate) with one coordinate per level of a count that is reached."""
    keys, count = np.unique(rows << BITS | at, return_counts=True)
    rows, at = keys >> BITS, keys & ((1 << BITS) - 1)
    r, x = [], []
    for level in LEVELS:
        on = count >= level
        r.append(rows[on])
        x.append(_leveled(at[on], level))
    return np.concatenate(r), np.concatenate(x)


def _featured(pdf: pd.DataFrame):
    batch = pa.RecordBatch.from_arrays([pa.array(pdf["text"], pa.string()), pa.array(pdf["toxic"], pa.int64())], ["text", "toxic"])
    for part in pieces(batch, "text", PIECE_BYTES):
        yield part.column("toxic").to_numpy(), *coordinates(*strings(part.column("text")))


def _screened(rate: float):
    """Sums of a shard's gradients and documents per coordinate where only the bias is fitted."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        g, c = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for y, rows, at in _featured(pdf):
            rows, at = features(rows, at)
            g += np.bincount(at, (rate - y)[rows], 1 << BITS)
            c += np.bincount(at, minlength=1 << BITS)
        seen = np.flatnonzero(c >= LEAST_DOCS)
        return pd.DataFrame({"at": seen, "g": g[seen], "c": c[seen]})

    return shard


def _reduced(known: np.ndarray):
    """A shard's documents as lists of the coordinates that passed the screen."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        wanted = _wanted(known)
        xs, ys = [], []
        for y, rows, at in _featured(pdf):
            on = wanted[at]
            rows, at = features(rows[on], at[on])
            on = np.isin(at, known)
            rows, at = rows[on], np.searchsorted(known, at[on])
            order = np.argsort(rows, kind="stable")
            xs += np.split(at[order], np.searchsorted(rows[order], np.arange(1, len(y))))
            ys += y.tolist()
        return pd.DataFrame({"x": [x.tolist() for x in xs], "toxic": ys, "shard": int(pdf["shard"].iloc[0])})

    return shard


def _wanted(known: np.ndarray) -> np.ndarray:
    """Which coordinates have a level in ``known``."""
    full = np.zeros(1 << BITS, bool)
    full[known] = True
    every = np.arange(1 << BITS)
    return np.any([full[_leveled(every, level)] for level in LEVELS], axis=0)


def _gradients(w: np.ndarray):
    """Per coordinate the sum of gradients and of their squares over a shard; the last is the bias."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["toxic"].to_numpy()
        rows = np.repeat(np.arange(len(y)), pdf["x"].map(len))
        x = np.concatenate([np.asarray(v, np.int64) for v in pdf["x"]])
        rows, x = np.concatenate([rows, np.arange(len(y))]), np.concatenate([x, np.full(len(y), len(w) - 1)])
        g = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[x], len(y)), -35, 35))) - y
        G, S = np.bincount(x, g[rows], len(w)), np.bincount(x, (g * g)[rows], len(w))
        seen = np.flatnonzero(S)
        return pd.DataFrame({"at": seen, "g": G[seen], "s": S[seen]})

    return shard


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) from labelled documents outside the held-out fold.

    Rows without a label or an id are not used; of several labels of an id the largest counts, and
    rows that repeat an id count each. Without any label all weights and the bias are 0: scores of 0.5.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("toxic IS NOT NULL AND doc_id IS NOT NULL").filter(fold != HELD_OUT)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic")).withColumn("hash", F.xxhash64("doc_id"))
    known = known.orderBy("hash", "doc_id").limit(TRAIN_ROWS).select("doc_id", "toxic")  # bounded, so it may be broadcast
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = text.join(F.broadcast(known), "doc_id")
    rows = saved(rows.select("text", "toxic", F.pmod(F.xxhash64("doc_id", "text"), F.lit(SHARDS)).cast("int").alias("shard")))
    total, positive = rows.agg(F.count("*"), F.sum("toxic")).first()
    if not total:
        return np.zeros(0, np.int64), np.zeros(0, np.float32), 0.0
    rate = (positive + 0.5) / (total + 1)
    screen = rows.groupBy("shard").applyInPandas(_screened(rate), "at long, g double, c double")
    screen = screen.groupBy("at").agg(F.sum("g").alias("g"), F.sum("c").alias("c"))
    # A coordinate far below its penalty on the bias alone stays at 0; the rest is at most 1 << BITS rows.
    screen = screen.filter(F.abs("g") > SCREEN * (DEVIATIONS * F.sqrt(F.col("c") * rate * (1 - rate)) + L1)).toPandas().sort_values("at")
    at, count = screen["at"].to_numpy(np.int64), np.append(screen["c"].to_numpy(), 0.0)
    # In buckets by shard, so that a round shuffles gradients only.
    lists = saved_by(rows.groupBy("shard").applyInPandas(_reduced(at), "x array<int>, toxic long, shard int"), "shard")
    m = len(at) + 1
    z, n, penalty, w = np.zeros(m), np.zeros(m), np.zeros(m), np.zeros(m)
    w[-1] = np.log(rate / (1 - rate))
    z[-1] = -w[-1] * BETA / ALPHA
    for _ in range(ROUNDS):
        part = lists.groupBy("shard").applyInPandas(_gradients(w), "at long, g double, s double")
        part = part.groupBy("at").agg(F.sum("g").alias("g"), F.sum("s").alias("s")).toPandas()
        g, s = np.zeros(m), np.zeros(m)
        g[part["at"]], s[part["at"]] = part["g"], part["s"]
        z += g - (np.sqrt(n + s) - np.sqrt(n)) / ALPHA * w
        n += s
        penalty += DEVIATIONS * np.sqrt(count * s[-1] / total) + L1
        penalty[-1] = 0
        w = np.where(np.abs(z) <= penalty, 0.0, -(z - np.sign(z) * penalty) / ((BETA + np.sqrt(n)) / ALPHA))
    keep = np.flatnonzero(w[:-1])
    return at[keep], w[keep].astype(np.float32), float(w[-1])


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep=("doc_id",), text: str = "text", score: str = "score") -> DataFrame:
    """The columns ``keep`` and ``score`` per row, from the whole text; null text counts as empty."""
    sent, own = docs.sparkSession.sparkContext.broadcast(model), text if text in keep else "_scored"

    def task(batches):
        at, w, bias = sent.value
        full = np.zeros(1 << BITS, np.float32)
        full[at] = w
        wanted = _wanted(at)
        for b in batches:
            for part in pieces(b, own, PIECE_BYTES):
                rows, x = coordinates(*strings(part.column(own)))
                hit = wanted[x]
                rows, x = features(rows[hit], x[hit])
                total = bias + np.bincount(rows, full[x], part.num_rows)
                p = pa.array(1 / (1 + np.exp(-np.clip(total, -35, 35))))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], p], [*keep, score])

    rows = docs.select(*keep) if own == text else docs.select(*keep, F.col(text).alias(own))
    return rows.mapInArrow(task, T.StructType([*rows.schema.fields[: len(keep)], T.StructField(score, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``; rows without an id are in fold 0.

    A null text is scored like an empty one (the bias alone), a text of any length whole; repeated
    rows get equal scores. Other columns are ignored whatever their names; an empty table gives
    an empty one, and without usable labels every score is 0.5.
    """
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % FOLDS
    out = scored(docs, fit(docs, labels))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def query(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = None
