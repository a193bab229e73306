"""Exact top-k inner products over buckets of vectors of similar length.

Components are scaled and floored to integers. All vectors are ranged by length and packed into
buckets, long ones first; a bucket knows its longest vector. Blocks of queries first meet the
longest bucket, whose k-th score is a bound for every query, and then those groups of buckets
that can still beat it. In a bucket a query's bound becomes a cosine threshold (bound over
length of the query times the bucket's longest vector): above 1 the bucket is passed over; below
the bucket's own switch point, only vectors long enough are looked at; above it, those whose
largest query coordinates lie in the interval that the angle allows. What survives is verified
by the integer product, and a better k-th score raises the bound for the next bucket.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronofleet.llm.common import ready, saved, shuffle_partitions, table

K = 10
EVERY = 100
SCALE = 1024
BUCKET_ROWS = 1 << 12
GROUP_ROWS = 1 << 16
QUERY_ROWS = 1 << 9
#: Query coordinates whose intervals are intersected, and queries that a bucket tries both ways on.
FOCUS = 3
TRIED = 8
#: Looking a vector up by coordinate costs so many times what a product in a block does.
LOOKUP = 4.0
#: Bounds are widened by this for rounding.
SLACK = 1e-9

BLOCK = "dim int, part int, block long, longest double, ids binary, vectors binary"
_EXACT = 2.0**53


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of integral doubles; Python integers where doubles can't hold them."""
    bound = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(c, axis=1).max(initial=0)
    if bound < _EXACT / 2:
        return q @ c.T
    q, c = ([[int(x) for x in row] for row in m] for m in (q, c))
    return np.array([[sum(map(int.__mul__, x, y)) for y in c] for x in q], object)


class Bucket:
    """Vectors by falling length, with an index by coordinate that is built when first needed."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        length = np.linalg.norm(v, axis=1)
        order = np.lexsort((ids, -length))
        self.ids, self.v, self.length = ids[order], v[order], length[order]
        self.longest = float(length.max(initial=0))
        self.switch: float | None = None
        self._lists = None

    def _index(self):
        if self._lists is None:
            unit = self.v / np.maximum(self.length, 1e-300)[:, None]
            order = np.argsort(unit, axis=0, kind="stable")
            self._lists = unit, order, np.take_along_axis(unit, order, 0)
        return self._lists

    def by_length(self, need: np.ndarray) -> np.ndarray:
        """How many first vectors have the needed length."""
        return np.searchsorted(-self.length, -need * (1 - SLACK), "right")

    def by_coordinate(self, unit: np.ndarray, cosine: float) -> tuple[np.ndarray, int]:
        """Vectors that can have the cosine with a query, and how many were looked at."""
        own, order, lists = self._index()
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        angle, open_ = np.arccos(np.clip(unit[focus], -1, 1)), np.arccos(min(1.0, cosine))
        low = np.cos(np.minimum(np.pi, angle + open_)) - SLACK
        high = np.cos(np.maximum(0, angle - open_)) + SLACK
        cut = [(int(np.searchsorted(lists[:, f], a, "left")), int(np.searchsorted(lists[:, f], b, "right"))) for f, a, b in zip(focus, low, high)]
        best = min(range(len(focus)), key=lambda k: cut[k][1] - cut[k][0])
        found = order[cut[best][0] : cut[best][1], focus[best]]
        looked = len(found)
        for k, f in enumerate(focus):
            if k != best and len(found):
                x = own[found, f]
                found = found[(x >= low[k]) & (x <= high[k])]
        return found, looked

    def tune(self, unit: np.ndarray, cosine: np.ndarray, first: np.ndarray) -> None:
        """Sets the local cosine threshold from which looking up by coordinate costs less."""
        order = np.argsort(cosine, kind="stable")
        tried = order[np.unique(np.linspace(0, len(order) - 1, TRIED).astype(int))]
        self.switch = 2.0
        for k in tried[::-1]:
            found, looked = self.by_coordinate(unit[k], float(cosine[k]))
            if LOOKUP * (looked + len(found)) >= first[k]:
                break
            self.switch = float(cosine[k])


class Best:
    """The k best (score, id) of each query of a block; bounds only rise."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, bound: np.ndarray, k: int):
        self.ids, self.v, self.k = ids, v, k
        self.length = np.linalg.norm(v, axis=1)
        self.unit = v / np.maximum(self.length, 1e-300)[:, None]
        self.bound = bound.copy()
        self.query, self.found, self.score = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64))

    def _add(self, query, found, score):
        if score.dtype == object and max(abs(x) for x in score) >= 1 << 63:
            raise ArithmeticError("a score doesn't fit a 64-bit integer")
        query, found = np.concatenate([self.query, query]), np.concatenate([self.found, found])
        score = np.concatenate([self.score, score.astype(np.int64)])
        order = np.lexsort((found, -score, query))
        query, found, score = query[order], found[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        on = place < self.k
        self.query, self.found, self.score = query[on], found[on], score[on]
        last = place == self.k - 1
        self.bound[query[last]] = np.maximum(self.bound[query[last]], score[last].astype(float))

    def _verify(self, bucket: Bucket, asked: np.ndarray, rows: np.ndarray | slice) -> None:
        """Products of queries with vectors of a bucket; those that reach the bound are added."""
        s = products(self.v[asked], bucket.v[rows])
        other = bucket.ids[rows][None, :] != self.ids[asked][:, None]
        s_ = np.where(other, s.astype(float), -np.inf)
        least = self.bound[asked]
        if s_.shape[1] >= self.k:
            kth = np.partition(s_, s_.shape[1] - self.k, axis=1)[:, s_.shape[1] - self.k]
            least = np.maximum(least, kth)
        # A score beyond 2 ** 53 is rounded here, so the bound is taken a little lower.
        least = np.where(np.isfinite(least), least * (1 - 1e-15 * np.sign(least)), least)
        q, n = np.nonzero(other & (s_ >= least[:, None]))
        if len(q):
            self._add(asked[q], bucket.ids[rows][n], s[q, n])

    def search(self, bucket: Bucket) -> None:
        if not len(bucket.ids):
            return
        reach = self.length * bucket.longest
        cosine = np.where(self.bound > 0, self.bound / np.maximum(reach, 1e-300), -1.0)
        live = np.flatnonzero(cosine <= 1 + SLACK)
        if not len(live):
            return
        need = np.where(self.bound > 0, self.bound / np.maximum(self.length, 1e-300), 0.0)
        first = bucket.by_length(need)
        if bucket.switch is None and (cosine[live] > 0).any():
            on = live[cosine[live] > 0]
            bucket.tune(self.unit[on], cosine[on], first[on])
        by_coordinate = (cosine >= (2.0 if bucket.switch is None else bucket.switch)) & (cosine > 0)
        plain = live[~by_coordinate[live]]
        plain = plain[np.argsort(-first[plain], kind="stable")]
        for a in range(0, len(plain), 128):
            part = plain[a : a + 128]
            if first[part[0]]:
                self._verify(bucket, part, slice(0, int(first[part[0]])))
        for k in live[by_coordinate[live]]:
            rows, _ = bucket.by_coordinate(self.unit[k], float(min(1.0, cosine[k])))
            rows = np.sort(rows[rows < first[k]])
            if len(rows):
                self._verify(bucket, np.array([k]), rows)


def _packed(most: int):
    """Rows (dim, part, vec_id, v) in order as blocks of ``most`` rows of one length, floored."""

    def task(batches):
        held, key, count = [], None, 0

        def block():
            nonlocal count
            t = pa.Table.from_batches(held)
            ids = t["vec_id"].to_numpy()
            data = t["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            v = np.floor(SCALE * data).reshape(len(ids), key[0])
            if not np.isfinite(v).all():
                raise ArithmeticError("a scaled component is beyond a double")
            count += 1
            cols = [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([key[1] << 32 | count], pa.int64()), pa.array([float(np.linalg.norm(v, axis=1).max())])]
            return pa.RecordBatch.from_arrays([*cols, pa.array([ids.tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary())], [c.split()[0] for c in BLOCK.split(", ")])

        for b in batches:
            if not b.num_rows:
                continue
            dim, part = b.column("dim").to_numpy(), b.column("part").to_numpy()
            change = np.flatnonzero(dim[1:] != dim[:-1]) + 1
            for x, y in zip(np.append(0, change), np.append(change, len(dim))):
                while x < y:
                    if held and (int(dim[x]) != key[0] or sum(h.num_rows for h in held) >= most):
                        yield block()
                        held = []
                    key = (int(dim[x]), int(part[x]))
                    take = min(y - x, most - sum(h.num_rows for h in held))
                    held.append(b.slice(x, take))
                    x += take
        if held:
            yield block()

    return task


def _read(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, np.int64)
    return ids, np.frombuffer(data, np.float64).reshape(len(ids), dim)


ASKED = "dim int, block long, ids binary, vectors binary, bound binary, need double"


def _seeded(k: int):
    """Blocks of queries with the k-th score each has in the longest bucket, and the length any of them still needs."""

    def task(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, v = _read(row["ids"], row["vectors"], row["dim"])
                best = Best(ids, v, np.full(len(ids), -np.inf), k)
                best.search(Bucket(*_read(row["of_ids"], row["of_vectors"], row["dim"])))
                need = np.where(best.bound > 0, best.bound / np.maximum(best.length, 1e-300), 0.0).min()
                yield pa.RecordBatch.from_pylist([{c: row[c] for c in ("dim", "block", "ids", "vectors")} | {"bound": best.bound.tobytes(), "need": float(need) * (1 - SLACK)}], pa.schema([("dim", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("bound", pa.binary()), ("need", pa.float64())]))

    return task


FOUND = "query long, query_id long, vec_id long, score long"


def _searched(k: int):
    """Blocks of queries against the buckets of their group, which come first in sorted rows."""

    def task(batches):
        buckets, key = [], None
        for b in batches:
            for i in range(b.num_rows):
                part, dim, kind = (b.column(c)[i].as_py() for c in ("part", "dim", "kind"))
                if (part, dim) != key:
                    buckets, key = [], (part, dim)
                ids, v = _read(b.column("ids")[i].as_py(), b.column("vectors")[i].as_py(), dim)
                if kind == 0:
                    buckets.append(Bucket(ids, v))
                    continue
                best = Best(ids, v, np.frombuffer(b.column("bound")[i].as_py(), np.float64), k)
                for bucket in sorted(buckets, key=lambda x: -x.longest):
                    best.search(bucket)
                # A row of a block is its query: a repeated id with another vector is another one.
                name = b.column("block")[i].as_py() * QUERY_ROWS + best.query
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(best.ids[best.query]), pa.array(best.found), pa.array(best.score)], ["query", "query_id", "vec_id", "score"])

    return task


def top_k(rows: DataFrame, asks: str | None = None, k: int = K, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` rows of largest integer product with each query.

    ``asks`` is a condition on ``vec_id`` that picks the queries, all rows without it. A query's
    own id is no candidate, ties go to the smaller id, and where there are fewer than ``k``
    candidates all are given. Vectors that are null or hold null or non-finite components and
    rows without an id take no part; vectors of different lengths don't meet. Rows that repeat
    an id and its vector are one; one id with several vectors has a list for each and is a
    candidate with each. Other columns are ignored; an empty table gives an empty one. A score
    beyond a long is an error.
    """
    spark = rows.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, v).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    every = saved(every.distinct().withColumns({"dim": F.size("v"), "length": length}))
    parts = ready(shuffle_partitions(spark), every.count(), GROUP_ROWS)
    order = ["dim", F.desc("length"), "vec_id"]
    ranged = every.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    buckets = saved(ranged.select("dim", F.spark_partition_id().alias("part"), "vec_id", "v").mapInArrow(_packed(BUCKET_ROWS), BLOCK))
    chosen = every.filter(asks) if asks else every
    queries = chosen.sortWithinPartitions("dim").select("dim", F.spark_partition_id().alias("part"), "vec_id", "v").mapInArrow(_packed(QUERY_ROWS), BLOCK)
    queries = saved(queries.select("dim", "block", "ids", "vectors"))
    first = buckets.groupBy("dim").agg(F.max(F.struct("longest", "block")).alias("top")).select("dim", F.col("top.block").alias("block"))
    first = buckets.join(first, ["dim", "block"]).select("dim", F.col("ids").alias("of_ids"), F.col("vectors").alias("of_vectors"))
    seeded = saved(queries.join(first, "dim").mapInArrow(_seeded(k), ASKED))
    groups = buckets.groupBy("dim", "part").agg(F.max("longest").alias("reach"))
    shape = ["part", "dim", "kind", "block", "ids", "vectors", "bound"]
    asked = seeded.join(groups, "dim").filter("reach >= need").withColumn("kind", F.lit(1)).select(*shape)
    there = buckets.withColumns({"kind": F.lit(0), "bound": F.lit(None).cast("binary")}).select(*shape)
    both = there.union(asked).repartition(parts, "part").sortWithinPartitions("part", "dim", "kind", "block")
    found = both.mapInArrow(_searched(k), FOUND)
    best = Window.partitionBy("query", "query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")


SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
    WHERE q.vec_id % 100 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 10
"""
