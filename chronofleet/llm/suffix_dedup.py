"""Repeated passages by bucket-pointer refinement over sparse suffixes.

A passage is a string of PASSAGE bytes that starts earlier too. Suffixes are bucketed by their
first Q bytes; buckets with one member are done, and the others are refined by the buckets of
later and earlier offsets until PASSAGE bytes tell members apart:

1. Every string of PASSAGE bytes has an anchor, the offset of its smallest Q-gram hash, which
   depends on the string only. Only anchors enter a bucket, about one suffix in 39.
2. A bucket is refined by the contexts of its members: all strings that have this anchor, as
   one. Later members of a context repeat a whole stretch; the first of each context goes on
   where its bucket holds another context.
3. These contexts are refined by the strings' common cores, eight strings each. A core that no
   other context has ends them.
4. What is left is refined to single strings, and all but the first of each are marked.

A batch of documents sends one entry per bucket and context (``batches.py``), so a passage in
every third document stays small. Equality rests on 96 bits of two hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofleet.llm import batches as bt
from chronofleet.llm.common import PIECE_BYTES, Rolling, mixed, ready, saved, saved_by, shuffle_partitions, table

PASSAGE = 100
Q = 24
CORE_STRINGS = 8
BUCKET_KEYS = 1 << 19
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
_SHIFT = np.uint64(64 - bt.KEY_BITS)


def _two(h: Rolling, start, end) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of a substring from those of its halves."""
    mid = start + (end - start) // 2
    x, y = h.of(start, mid), h.of(mid, end)
    return mixed(x * _A + y * _B), mixed(x * _C ^ y * _D)


def anchors(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of strings with one anchor: row, first and last start, anchor, bucket and context hashes."""
    out = []
    at, last = 0, len(offs) - 1
    while at < last:
        to = min(max(int(np.searchsorted(offs, offs[at] + PIECE_BYTES, "right")) - 1, at + 1), last)
        base = offs[at]
        part, cut = buf[base : offs[to]], offs[at : to + 1] - base
        n = len(part) - PASSAGE + 1
        if n > 0:
            h = Rolling(part)
            i = np.arange(len(part) - Q + 1)
            q = h.of(i, i + Q)
            bits = np.uint64(max(20, len(part).bit_length()))
            low = q >> bits << bits | i.astype(np.uint64)
            width, span = 1, PASSAGE - Q + 1
            while width * 2 <= span:
                low = np.minimum(low[:-width], low[width:])
                width *= 2
            low = np.minimum(low[:n], low[span - width : span - width + n])
            row = np.repeat(np.arange(to - at), np.diff(cut))[:n]
            x = np.flatnonzero(np.arange(n) + PASSAGE <= cut[row + 1])
            if len(x):
                a = (low[x] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
                new = np.ones(len(x), bool)
                new[1:] = (a[1:] != a[:-1]) | (x[1:] != x[:-1] + 1)
                s = np.flatnonzero(new)
                x1, x2, a = x[s], x[np.append(s[1:], len(x)) - 1], a[s]
                c1, c2 = _two(h, x1, x2 + PASSAGE)
                shape = (a - x1).astype(np.uint64)
                # Anchors are smallest hashes: mixed again, or they all fall in the first buckets.
                out.append((row[x1] + at, x1 + base, x2 + base, a + base, mixed(q[a]), mixed(c1 + shape), mixed(c2 + shape)))
        at = to
    names = ("row", "x1", "x2", "a", "bucket", "c1", "c2")
    kinds = (np.int64,) * 4 + (np.uint64,) * 3
    return {n: np.concatenate([o[i] for o in out]) if out else np.zeros(0, k) for i, (n, k) in enumerate(zip(names, kinds))}


ENTRY = "kind int, bucket int, batch long, n int, keys binary, more binary"


def _rank(ids: np.ndarray) -> np.ndarray:
    rank = np.empty(len(ids), np.int64)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return rank


def _firsts(c1, c2, rank, x) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first member of each distinct (c1, c2), in the order of c1, and who is first."""
    order = np.lexsort((x, rank, c2, c1))
    new = np.ones(len(order), bool)
    new[1:] = (c1[order][1:] != c1[order][:-1]) | (c2[order][1:] != c2[order][:-1])
    first = order[new]
    mask = np.zeros(len(order), bool)
    mask[first] = True
    return first, mask


def _six(x: np.ndarray) -> bytes:
    return (x >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes, n: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8, 6 * n, at).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _entries(kind: int, batch: int, keys: np.ndarray, more, buckets: int) -> pa.RecordBatch:
    """Questions with sorted keys; ``more(a, b)`` gives the further bytes of a range of them."""
    keys = keys >> _SHIFT
    at = bt.cuts(keys, buckets)
    where = [i for i in range(buckets) if at[i + 1] > at[i]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([kind] * len(where), pa.int32()), pa.array(where, pa.int32()), pa.array([batch] * len(where), pa.int64()), pa.array([at[i + 1] - at[i] for i in where], pa.int32()),
            pa.array([bt.encoded(keys[at[i] : at[i + 1]]) for i in where], pa.binary()), pa.array([more(at[i], at[i + 1]) for i in where], pa.binary()),
        ],
        ["kind", "bucket", "batch", "n", "keys", "more"],
    )


def _owned(c1: np.ndarray, c2: np.ndarray, ids: np.ndarray, batch: int, buckets: int) -> pa.RecordBatch:
    """Asks for each string or context, sorted by c1, whether an earlier document has it."""

    def more(a, b):
        own = ids[a:b]
        low = int(own.min())
        small = int(own.max()) - low < 1 << 32
        return bytes([small]) + np.int64(low).tobytes() + (own - low).astype(np.uint32 if small else np.uint64).tobytes() + _six(c2[a:b])

    return _entries(1, batch, c1, more, buckets)


def _buckets_of(s: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct buckets of a batch, one context of each, whether there are more, and who is where."""
    keys, first, back = np.unique(s["bucket"] >> _SHIFT, return_index=True, return_inverse=True)
    one = s["c1"][first]
    several = np.zeros(len(keys), bool)
    several[back[s["c1"] != one[back]]] = True
    return keys << _SHIFT, one, several, back


def _ask(buckets: int):
    def task(batches):
        for r in bt.rows_of(batches):
            ids, buf, offs = bt.unpacked(r)
            s = anchors(buf, offs)
            if not len(s["row"]):
                continue
            keys, one, several, _ = _buckets_of(s)
            yield _entries(0, r["batch"], keys, lambda a, b: several[a:b].astype(np.uint8).tobytes() + _six(one[a:b]), buckets)
            first, _ = _firsts(s["c1"], s["c2"], _rank(ids)[s["row"]], s["x1"])
            yield _owned(s["c1"][first], s["c2"][first], ids[s["row"][first]], r["batch"], buckets)

    return task


ANSWER = "kind int, " + bt.ANSWERED


def _starts(*sorted_keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _answers(pdf: pd.DataFrame) -> pd.DataFrame:
    """Kind 0: 1 if a bucket has several contexts. Kind 1: 1 if an earlier document has the same."""
    n, kind = pdf["n"].to_numpy(), int(pdf["kind"].iloc[0])
    keys = np.concatenate([bt.decoded(k, m) for k, m in zip(pdf["keys"], n)])
    answer = np.zeros(len(keys), np.uint8)
    if kind == 0:
        several = np.concatenate([np.frombuffer(b, np.uint8, m) for b, m in zip(pdf["more"], n)])
        one = np.concatenate([_from_six(b, m, m) for b, m in zip(pdf["more"], n)])
        order = np.lexsort((one, keys))
        at = _starts(keys[order])
        many = np.diff(np.append(at, len(keys)))
        ends = at + many - 1
        yes = np.maximum.reduceat(several[order], at).astype(bool) | (one[order][at] != one[order][ends])
        answer[order] = np.repeat(yes, many)
    else:
        ids, checks = [], []
        for b, m in zip(pdf["more"], n):
            width = 4 if b[0] else 8
            ids.append(np.frombuffer(b, np.uint32 if b[0] else np.uint64, m, 9).astype(np.int64) + int(np.frombuffer(b, np.int64, 1, 1)[0]))
            checks.append(_from_six(b, m, 9 + width * m))
        ids, checks = np.concatenate(ids), np.concatenate(checks)
        batch = np.repeat(pdf["batch"].to_numpy(), n)
        order = np.lexsort((batch, ids, checks, keys))
        answer[:] = 1
        answer[order[_starts(keys[order], checks[order])]] = 0
    ends = np.cumsum(n)
    return pd.DataFrame({"kind": kind, "batch": pdf["batch"], "bucket": pdf["bucket"], "answers": [answer[e - m : e].tobytes() for e, m in zip(ends, n)]})


CONTEXTS = "batch long, ids binary, known binary, row binary, x binary, strings binary, lead binary, data binary"


def _merged(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Covered stretches as rows of (row, start, end), overlaps joined; offsets are absolute."""
    if not len(row):
        return np.zeros((0, 3), np.int64)
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    reach = np.maximum.accumulate(end)  # offsets grow with the row, so rows stay apart
    new = np.ones(len(row), bool)
    new[1:] = (start[1:] > reach[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return np.stack([row[at], start[at], reach[np.append(at[1:], len(row)) - 1]], 1)


def _contexts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Known repeats of a batch and the contexts that go on, with their bytes."""
    out = []
    for _, r in left.iterrows():
        ids, buf, offs = bt.unpacked(r)
        s = anchors(buf, offs)
        known, go = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)
        if len(s["row"]):
            _, _, _, back = _buckets_of(s)
            several = bt.in_order(right[right["kind"] == 0])[back].astype(bool)
            first, mask = _firsts(s["c1"], s["c2"], _rank(ids)[s["row"]], s["x1"])
            later = ~mask
            later[first[bt.in_order(right[right["kind"] == 1]).astype(bool)]] = True
            known = _merged(s["row"][later], s["x1"][later], s["x2"][later] + PASSAGE)
            go = np.flatnonzero(~later & several)
        x1, x2 = s["x1"][go], s["x2"][go]
        size = x2 - x1 + PASSAGE
        at = np.repeat(x1 - np.concatenate([[0], np.cumsum(size)[:-1]]) if len(go) else x1, size) + np.arange(size.sum())
        data = zstandard.ZstdCompressor(level=1).compress(buf[at].tobytes())
        out.append((r["batch"], r["ids"], known.tobytes(), s["row"][go].tobytes(), x1.tobytes(), (x2 - x1 + 1).tobytes(), (s["a"][go] - x1).tobytes(), data))
    return pd.DataFrame(out, columns=[c.split()[0] for c in CONTEXTS.split(", ")])


class _Strings:
    """All strings of a batch's contexts: context, distance to the anchor, hashes of core and string."""

    def __init__(self, r):
        self.ids = np.frombuffer(r["ids"], np.int64)
        self.row, self.x, many, lead = (np.frombuffer(r[c], np.int64) for c in ("row", "x", "strings", "lead"))
        size = many + PASSAGE - 1
        total = int(size.sum())
        buf = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"], max_output_size=total), np.uint8) if total else np.zeros(0, np.uint8)
        self.h = Rolling(buf)
        begin = np.cumsum(size) - size
        self.of = np.repeat(np.arange(len(many)), many)
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        self.start = begin[self.of] + step
        self.at = self.x[self.of] + step
        far = lead[self.of] - step
        group = far // CORE_STRINGS
        core = begin[self.of] + lead[self.of] - group * CORE_STRINGS
        self.core = mixed(self.h.of(core, core + PASSAGE - CORE_STRINGS + 1) + group.astype(np.uint64)) if len(core) else np.zeros(0, np.uint64)
        # A context asks once for a core, however many of its strings share it.
        new = np.ones(len(core), bool)
        new[1:] = (self.of[1:] != self.of[:-1]) | (group[1:] != group[:-1])
        self.keys, inverse, self.counts = np.unique(self.core[new] >> _SHIFT, return_inverse=True, return_counts=True)
        self.key_of = inverse[np.cumsum(new) - 1] if len(core) else np.zeros(0, np.int64)

    def narrowed(self, cores: np.ndarray):
        """Strings whose core is shared: index, hashes."""
        on = np.flatnonzero(cores[self.key_of] > 0) if len(self.key_of) else np.zeros(0, np.int64)
        c1, c2 = _two(self.h, self.start[on], self.start[on] + PASSAGE) if len(on) else (np.zeros(0, np.uint64),) * 2
        first, mask = _firsts(c1, c2, _rank(self.ids)[self.row[self.of[on]]], self.at[on])
        return on, c1, c2, first, mask


def _ask_cores(buckets: int):
    def task(batches):
        for r in bt.rows_of(batches):
            s = _Strings(r)
            if len(s.keys):
                yield bt.asked(r["batch"], s.keys, s.counts, buckets)

    return task


def _ask_strings(buckets: int):
    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, r in left.iterrows():
            s = _Strings(r)
            on, c1, c2, first, _ = s.narrowed(bt.in_order(right))
            if len(on):
                out.append(_owned(c1[first], c2[first], s.ids[s.row[s.of[on[first]]]], r["batch"], buckets).to_pandas())
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in ENTRY.split(", ")])

    return ask


COVERED = "batch long, stretches binary"


def _covered(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, r in left.iterrows():
        s = _Strings(r)
        on, _, _, first, mask = s.narrowed(bt.in_order(right[right["kind"] == 2]))
        later = ~mask
        later[first[bt.in_order(right[right["kind"] == 1]).astype(bool)]] = True
        known = np.frombuffer(r["known"], np.int64).reshape(-1, 3)
        hit = on[later]
        row, start = np.concatenate([known[:, 0], s.row[s.of[hit]]]), np.concatenate([known[:, 1], s.at[hit]])
        out.append((r["batch"], _merged(row, start, np.concatenate([known[:, 2], s.at[hit] + PASSAGE])).tobytes()))
    return pd.DataFrame(out, columns=["batch", "stretches"])


REMOVED = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"
DIGESTS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _apply(digest: bool):
    def task(left: pd.DataFrame, right: pd.DataFrame):
        out = []
        for _, r in left.iterrows():
            ids, buf, offs = bt.unpacked(r)
            cover = np.concatenate([np.frombuffer(b, np.int64).reshape(-1, 3) for b in right["stretches"]]) if len(right) else np.zeros((0, 3), np.int64)
            cut = np.searchsorted(cover[:, 0], np.arange(len(ids) + 1))
            for i in range(len(ids)):
                mine = cover[cut[i] : cut[i + 1], 1:] - offs[i]
                n = int(offs[i + 1] - offs[i])
                doc = buf[offs[i] : offs[i + 1]]
                edge = np.concatenate([[0], mine.ravel(), [n]])
                kept = b"".join([doc[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2])])
                if digest:
                    out.append((ids[i], n, n - len(kept), len(mine), hashlib.sha256(kept).hexdigest()))
                else:
                    out.append((ids[i], n, mine[:, 0].tolist(), mine[:, 1].tolist(), kept))
        return pd.DataFrame(out, columns=[c.split()[0] for c in (DIGESTS if digest else REMOVED).split(", ")])

    return task


def _without_id(batches):
    for b in batches:
        data = [(t or "").encode() for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())], ["doc_id", "n_bytes", "kept"])


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, starts and ends of what is removed and the kept bytes; or their digests.

    A byte goes if a PASSAGE-byte string that covers it also starts earlier: in a smaller
    doc_id, in the same document before, or, where an id repeats, in a row read before. Null and
    short texts lose nothing, nor do rows without an id, which nothing is compared with.
    """
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    packs = bt.packed(rows)
    n_bytes = packs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets = ready(parts, n_bytes * 3 // 39, BUCKET_KEYS)
    asked = packs.mapInArrow(_ask(buckets), ENTRY)
    answers = asked.groupBy("kind", "bucket").applyInPandas(_answers, ANSWER)
    contexts = saved_by(packs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInPandas(_contexts, CONTEXTS), "batch")
    cores = contexts.mapInArrow(_ask_cores(buckets), bt.ASKED).groupBy("bucket").applyInPandas(bt.frequency_classes, bt.ANSWERED)
    cores = saved(cores)
    strings = contexts.groupBy("batch").cogroup(cores.groupBy("batch")).applyInPandas(_ask_strings(buckets), ENTRY)
    owned = strings.groupBy("kind", "bucket").applyInPandas(_answers, ANSWER)
    both = owned.union(cores.select(F.lit(2).alias("kind"), "batch", "bucket", "answers"))
    cover = contexts.groupBy("batch").cogroup(both.groupBy("batch")).applyInPandas(_covered, COVERED)
    out = packs.groupBy("batch").cogroup(cover.groupBy("batch")).applyInPandas(_apply(digest), DIGESTS if digest else REMOVED)
    lost = rows.filter("doc_id IS NULL").mapInArrow(_without_id, "doc_id long, n_bytes long, kept binary")
    if digest:
        lost = lost.select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    else:
        none = F.array().cast("array<long>")
        lost = lost.select("doc_id", "n_bytes", none.alias("starts"), none.alias("ends"), "kept")
    return out.union(lost)


def query(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents"), digest=True)


SQL = None
