"""Near-duplicate embeddings by a navigable small-world graph per shard.

Distinct vectors are dealt to shards by hash. Each shard builds a hierarchical graph; every
vector then queries every shard in blocks. A beam search walks down the layers; a beam that holds
nothing but nodes near the threshold is widened, and where that would look at more nodes than a
scan of the shard, as inside a group of near vectors that is a large part of it, the shard is
scanned for that query. Before it answers, a shard audits itself with probes at the threshold
against brute force and widens its beam until the recall is met, over all pairs as well as on
average per probe. Candidates are verified by cosine in double precision.

A shard answers with one row per vector that has links there, their number, and with links
that join components only: a group of near vectors of any size gives about as many rows as it has
members, never all its pairs. A group of equal vectors is one node with a weight.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofleet.llm.common import ready, saved, shuffle_partitions, table
from chronofleet.llm.graph import components

COSINE = 0.9
#: Similarity down to which all nodes are walked on from.
NEAR = 0.85
SHARDS = 8
SHARD_ROWS = 1 << 17
LINKS = 16
BUILD_BEAM = 48
BEAM = 32
RECALL = 0.99
PROBES = 128
BLOCK_ROWS = 1 << 11
#: Queries times nodes that one search marks as seen.
SEEN_CELLS = 1 << 24
#: Layers of so many nodes are scanned.
SCANNED = 1 << 10
#: A walk costs so many times what a scan does for each node that it looks at.
WALK = 2
_STEP = 4


def _search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: np.ndarray, beam: int, near: float | None = None):
    """Beam of each query (ids, similarities) and, with ``near``, all (query, node) seen above it."""
    n, many = len(x), len(q)
    seen = np.zeros((many, n), bool)
    ids = np.full((many, beam), -1, np.int64)
    sims = np.full((many, beam), -np.inf, np.float32)
    done = np.ones((many, beam), bool)
    ids[:, 0] = entry
    sims[:, 0] = np.einsum("qd,qd->q", q, x[entry])
    done[:, 0] = False
    seen[np.arange(many), entry] = True
    hit_q, hit_n = [], []
    if near is not None:
        first = np.flatnonzero(sims[:, 0] >= near)
        hit_q.append(first)
        hit_n.append(entry[first])
    active = np.arange(many)
    step = min(_STEP, beam)
    while len(active):
        open_ = np.where(done[active], -np.inf, sims[active])
        pick = np.argpartition(-open_, step - 1, axis=1)[:, :step] if step < beam else np.argsort(-open_, axis=1)
        value = np.take_along_axis(open_, pick, 1)
        go = value > -np.inf
        on = go.any(axis=1)
        active, pick, go = active[on], pick[on], go[on]
        if not len(active):
            break
        flagged = done[active]
        np.put_along_axis(flagged, pick, True, 1)
        done[active] = flagged
        node = np.where(go, np.take_along_axis(ids[active], pick, 1), -1)
        nb = np.where(node[:, :, None] >= 0, graph[node], -1).reshape(len(active), -1)
        nb.sort(axis=1)
        fresh = nb >= 0
        fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        fresh &= ~seen[active[:, None], nb]
        r, c = np.nonzero(fresh)
        if not len(r):
            continue
        target = nb[r, c]
        seen[active[r], target] = True
        s = np.einsum("kd,kd->k", q[active[r]], x[target])
        if near is not None:
            hit = s >= near
            hit_q.append(active[r[hit]])
            hit_n.append(target[hit])
        new_s = np.full(nb.shape, -np.inf, np.float32)
        new_s[r, c] = s
        all_s = np.concatenate([sims[active], new_s], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[active] = np.take_along_axis(all_s, top, 1)
        ids[active] = np.take_along_axis(np.concatenate([ids[active], nb], 1), top, 1)
        done[active] = np.take_along_axis(np.concatenate([done[active], np.zeros(nb.shape, bool)], 1), top, 1) | ~np.isfinite(sims[active])
    if near is None:
        return ids, sims
    return ids, sims, np.concatenate(hit_q), np.concatenate(hit_n)


def _diverse(x: np.ndarray, cand: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates those nearer to the row's vector than to any taken before."""
    order = np.argsort(-sim, axis=1, kind="stable")
    cand, sim = np.take_along_axis(cand, order, 1), np.take_along_axis(sim, order, 1)
    v = x[np.maximum(cand, 0)]
    among = np.einsum("qcd,qed->qce", v, v)
    valid = (cand >= 0) & np.isfinite(sim)
    closest = np.full(cand.shape, -np.inf, np.float32)
    out = np.full((len(cand), most), -1, np.int64)
    count = np.zeros(len(cand), np.int64)
    for c in range(cand.shape[1]):
        take = valid[:, c] & (count < most) & (sim[:, c] > closest[:, c])
        rows = np.flatnonzero(take)
        out[rows, count[rows]] = cand[rows, c]
        count[rows] += 1
        closest[rows] = np.maximum(closest[rows], among[rows, c])
    return out


class Graph:
    """A hierarchical navigable small-world graph over unit vectors; nodes come in random order."""

    def __init__(self, x: np.ndarray, level: np.ndarray):
        self.x = x
        self.nodes = [np.flatnonzero(level >= k) for k in range(int(level.max(initial=0)) + 1)]
        self.graphs: list[np.ndarray] = [None] * len(self.nodes)
        for k in range(len(self.nodes) - 1, -1, -1):
            self.graphs[k] = self._layer(k)

    def _entry(self, q: np.ndarray, above: int) -> np.ndarray:
        """Node of the layer below ``above`` to begin at, after walking down to ``above``."""
        at = np.zeros(len(q), np.int64)
        for k in range(len(self.nodes) - 1, above - 1, -1):
            own = self.nodes[k]
            if len(own) <= SCANNED:  # no walk that could stay inside the group it begins in
                best = own[(q @ self.x[own].T).argmax(axis=1)]
                at = np.searchsorted(self.nodes[k - 1], best) if k else best
                continue
            ids, sims = _search(self.x[own], self.graphs[k], q, at, 4)
            best = own[np.take_along_axis(ids, sims.argmax(axis=1)[:, None], 1)[:, 0]]
            at = np.searchsorted(self.nodes[k - 1], best) if k else best
        return at

    def _layer(self, k: int) -> np.ndarray:
        own = self.nodes[k]
        x, most = self.x[own], LINKS * (2 if k == 0 else 1)
        graph = np.full((len(own) + 1, most), -1, np.int64)  # the last row is for node -1
        size = min(len(own), 2 * LINKS)
        self._link(x, graph, np.arange(size), *self._among(x, np.arange(size)))
        while size < len(own):
            new = np.arange(size, min(len(own), size + min(size, 512)))
            cand, sim = self._among(x, new)
            seeds = np.arange(min(size, SCANNED // 4))  # where the entry is not linked yet
            width = max(1, SEEN_CELLS // max(1, size))
            found = []
            for a in range(0, len(new), width):
                part = x[new[a : a + width]]
                entry = self._entry(part, k + 1) if k + 1 < len(self.nodes) else np.zeros(len(part), np.int64)
                entry = np.where(entry < size, entry, (part @ x[seeds].T).argmax(axis=1))
                found.append(_search(x[:size], graph, part, entry, BUILD_BEAM))
            ids, s = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            self._link(x, graph, new, np.concatenate([ids, cand], 1), np.concatenate([s, sim], 1))
            size += len(new)
        return graph

    @staticmethod
    def _among(x: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest others of a batch that is inserted at once."""
        s = x[new] @ x[new].T
        np.fill_diagonal(s, -np.inf)
        top = np.argsort(-s, axis=1)[:, :LINKS]
        return new[top], np.take_along_axis(s, top, 1)

    @staticmethod
    def _link(x, graph, new, cand, sim):
        most = graph.shape[1]
        graph[new] = -1
        graph[new, :LINKS] = _diverse(x, cand, sim, LINKS)
        src, dst = np.repeat(new, most), graph[new].ravel()
        on = dst >= 0
        src, dst = src[on], dst[on]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        target, at, many = np.unique(dst, return_index=True, return_counts=True)
        back = np.full((len(target), int(many.max(initial=0))), -1, np.int64)
        back[np.repeat(np.arange(len(target)), many), np.arange(len(dst)) - np.repeat(at, many)] = src
        for a in range(0, len(target), 256):
            t = target[a : a + 256]
            both = np.concatenate([graph[t], back[a : a + 256]], 1)
            both.sort(axis=1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
            s = np.where(both >= 0, np.einsum("qd,qcd->qc", x[t], x[np.maximum(both, 0)]), -np.inf)
            full = (both >= 0).sum(axis=1) > most
            # A hub may be offered links by a whole batch; it chooses among the nearest and those it has.
            old = ((both[:, :, None] == graph[t][:, None, :]) & (both >= 0)[:, :, None]).any(axis=2)
            order = np.argsort(-np.where(old, s + 4, s), axis=1)[:, : 4 * most]
            both, s = np.take_along_axis(both, order, 1), np.take_along_axis(s, order, 1)
            keep = both[:, :most].copy()  # all there are, where no choice is needed
            if full.any():
                keep[full] = _diverse(x, both[full], s[full], most)
            graph[t] = -1
            graph[t, : keep.shape[1]] = keep

    def near(self, q: np.ndarray, beam: int, least: float):
        """Yields (query, node) of all nodes found with a similarity of ``least``, some queries at a time."""
        n = len(self.x)
        for a in range(0, len(q), max(1, min(512, SEEN_CELLS // max(1, n)))):
            todo, wide = np.arange(a, min(a + max(1, min(512, SEEN_CELLS // max(1, n))), len(q))), beam
            while len(todo) and WALK * wide * LINKS < n:
                entry = self._entry(q[todo], 1) if len(self.nodes) > 1 else np.zeros(len(todo), np.int64)
                _, sims, hit_q, hit_n = _search(self.x, self.graphs[0], q[todo], entry, wide, least)
                short = sims.min(axis=1) >= NEAR
                keep = ~short[hit_q]
                yield todo[hit_q[keep]], hit_n[keep]
                todo, wide = todo[short], wide * 4
            if len(todo):
                hit_q, hit_n = np.nonzero(q[todo] @ self.x.T >= least)
                yield todo[hit_q], hit_n

    def audited(self, beam: int) -> tuple[int, float]:
        """The beam at which probes find RECALL of what brute force finds, and the recall.

        It is the least of three: over all pairs, the mean over probes (a group with thousands of
        pairs counts no more than a single pair), and the share of probes that find their own base.
        """
        rng = np.random.default_rng(len(self.x))
        own = np.linspace(0, len(self.x) - 1, min(PROBES, len(self.x))).astype(int)
        base = self.x[own]
        noise = rng.standard_normal(base.shape).astype(np.float32)
        noise -= np.einsum("qd,qd->q", noise, base)[:, None] * base
        norm = np.linalg.norm(noise, axis=1, keepdims=True)
        c = np.float32(COSINE + 0.01)
        q = c * base + np.sqrt(1 - c * c) * noise / np.where(norm > 0, norm, 1)
        want = q @ self.x.T >= COSINE
        want[np.arange(len(base)), own] = True
        while True:
            got = np.zeros_like(want)
            for found in self.near(q, beam, COSINE):
                got[found] = True
            got &= want
            recall = float(min(got.sum() / want.sum(), (got.sum(axis=1) / want.sum(axis=1)).mean(), got[np.arange(len(base)), own].mean()))
            if recall >= RECALL or beam >= len(self.x):
                return beam, recall
            beam *= 2


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


BLOCK = "shard int, dim int, kind int, ids binary, sizes binary, vectors binary"


def _packed(kind: int, dtype: str):
    """Rows (shard, dim, rep, size, v) sorted by shard and dim as blocks."""

    def task(batches):
        held, key = [], None

        def block():
            t = pa.Table.from_batches(held)
            ids, sizes = t["rep"].to_numpy(), t["size"].to_numpy()
            data = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            cols = [pa.array([x], pa.int32()) for x in (*key, kind)] + [pa.array([x.tobytes()], pa.binary()) for x in (ids, sizes, data.astype(dtype))]
            return pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BLOCK.split(", ")])

        limit = BLOCK_ROWS if kind else 1 << 62
        for b in batches:
            if not b.num_rows:
                continue
            k = np.stack([b.column("shard").to_numpy(), b.column("dim").to_numpy()], 1)
            change = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
            for x, y in zip(np.append(0, change), np.append(change, len(k))):
                while x < y:
                    if held and (tuple(k[x]) != key or sum(h.num_rows for h in held) >= limit):
                        yield block()
                        held = []
                    key = tuple(k[x].tolist())
                    take = min(y - x, limit - sum(h.num_rows for h in held))
                    held.append(b.slice(x, take))
                    x += take
        if held:
            yield block()

    return task


def _levels(ids: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    h = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.floor(-np.log(np.maximum(h, 1e-12)) / np.log(LINKS)).astype(np.int64)


class Shard:
    """The vectors of a shard, their audited graph, and which of them are joined by links given so far."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, v: np.ndarray):
        order = np.argsort((ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(7), kind="stable")
        self.ids, self.sizes = ids[order], sizes[order]
        self.v = v[order] / np.abs(v[order]).max(axis=1, keepdims=True)
        self.norms = np.linalg.norm(self.v, axis=1)
        self.graph = Graph(_unit(v[order]), _levels(self.ids))
        self.beam, self.recall = self.graph.audited(BEAM)
        self.joined = np.arange(len(ids))

    def _verified(self, v: np.ndarray, q: np.ndarray, n: np.ndarray) -> np.ndarray:
        ok = np.zeros(len(q), bool)
        for at in range(0, len(q), 1 << 16):
            x, m = v[q[at : at + (1 << 16)]], n[at : at + (1 << 16)]
            ok[at : at + (1 << 16)] = np.einsum("kd,kd->k", x, self.v[m]) / (np.linalg.norm(x, axis=1) * self.norms[m]) >= COSINE
        return ok

    def answer(self, ids: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        """(a, b, others): how many vectors each query links with, and links that join components."""
        others, links = np.zeros(len(ids), np.int64), []
        scaled = v / np.abs(v).max(axis=1, keepdims=True)
        for q, n in self.graph.near(_unit(v), self.beam, COSINE - 1e-4):
            on = ids[q] != self.ids[n]
            q, n = q[on], n[on]
            on = self._verified(scaled, q, n)
            q, n = q[on], n[on]
            others += np.bincount(q, self.sizes[n], len(ids)).astype(np.int64)
            order = np.argsort(q, kind="stable")
            q, n = q[order], n[order]
            for k, own in zip(q[np.flatnonzero(np.append(True, q[1:] != q[:-1]))] if len(q) else [], np.split(n, np.flatnonzero(q[1:] != q[:-1]) + 1)):
                of, first = np.unique(self.joined[own], return_index=True)
                links += [(ids[k], self.ids[m]) for m in own[first]]
                if len(of) > 1:
                    self.joined[np.isin(self.joined, of)] = of[0]
        counted = np.flatnonzero(others)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        none = pa.nulls(len(counted), pa.int64())
        cols = [pa.concat_arrays(x) for x in ([pa.array(ids[counted]), pa.array(a)], [none, pa.array(b)], [pa.array(others[counted]), pa.nulls(len(a), pa.int64())])]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "others"])


def _query_shards(dtype: str):
    """Blocks of queries against the graph of their shard, which comes first in sorted rows."""

    def task(batches):
        shard = key = None
        for b in batches:
            for i in range(b.num_rows):
                no, dim, kind, ids, sizes, data = (b.column(c)[i].as_py() for c in ("shard", "dim", "kind", "ids", "sizes", "vectors"))
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(data, dtype).reshape(-1, dim).astype(np.float64)
                if kind == 0:
                    shard, key = Shard(ids, np.frombuffer(sizes, np.int64), v), (no, dim)
                elif key == (no, dim):
                    yield shard.answer(ids, v)

    return task


def near_links(nodes: DataFrame) -> DataFrame:
    """(a, b, others) for the distinct vectors of ``nodes`` (rep, size, v).

    Rows with ``others`` tell how many vectors ``a`` links with in one shard; the other rows are links,
    enough of them to connect what is connected. Vectors of single precision travel as such.
    """
    spark = nodes.sparkSession
    parts = shuffle_partitions(spark)
    shards = ready(SHARDS, nodes.count(), SHARD_ROWS)
    dtype = "f4" if nodes.schema["v"].dataType == T.ArrayType(T.FloatType()) else "f8"
    rows = nodes.select("rep", "size", "v", F.size("v").alias("dim"))
    shape = ["shard", "dim", "rep", "size", "v"]
    own = rows.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    own = own.repartition(max(parts, shards), "shard", "dim").sortWithinPartitions("shard", "dim", "rep").select(*shape)
    graphs = saved(own.mapInArrow(_packed(0, dtype), BLOCK))
    blocks = saved(rows.withColumn("shard", F.lit(0)).sortWithinPartitions("dim").select(*shape).mapInArrow(_packed(1, dtype), BLOCK))
    asks = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    every = graphs.unionByName(asks).select(*[c.split()[0] for c in BLOCK.split(", ")])
    every = every.repartition(max(parts, 4 * shards), "shard").sortWithinPartitions("shard", "dim", "kind")
    return saved(every.mapInArrow(_query_shards(dtype), "a long, b long, others long"))


def near_duplicates(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept per row.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths or rows without an id. Equal vectors link with each other. A
    row that repeats an id and its vector counts once as a neighbour. A cosine of exactly COSINE
    links, other columns are ignored whatever their names, and an empty table gives an empty one.
    """
    v = F.col(vector)
    if rows.schema[vector].dataType != T.ArrayType(T.FloatType()):
        v = v.cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(F.coalesce(fine, F.lit(False)), v).alias("v"))
    usable = every.filter("v IS NOT NULL AND vec_id IS NOT NULL").distinct()
    nodes = saved(usable.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")))
    found = near_links(nodes)
    counted = found.filter("others IS NOT NULL").groupBy("a").agg(F.sum("others").alias("others"))
    comp = components(found.filter("others IS NULL").select("a", "b"))
    per = nodes.select("rep", "size").join(counted, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("node"), "left")
    per = per.select("rep", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    member = every.join(nodes.select(F.col("v").alias("of"), "rep"), F.col("v") == F.col("of"), "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("rep")).alias("mine"))
    out = member.join(per, F.col("mine") == F.col("rep"), "left")
    comp = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("vec_id") == comp, F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = None
