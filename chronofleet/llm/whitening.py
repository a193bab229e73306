"""Whitening by a Jacobi-Davidson solver over distributed centred products.

Entries become integers; distinct vectors are the fit list, whose size and sums are exact. Its
deviations from the mean are written once as blocks of doubles (each the rounded quotient of
an exact integer), so nothing is lost to the offset of the data. The covariance is never
formed: the solver asks for products of it with a few columns, and each is one job that sums
``C' (C u)`` over blocks.

Wanted pairs are improved together. A Rayleigh-Ritz step on the subspace gives Ritz pairs; of
each a correction equation, projected against locked and current vectors, is solved by a few
steps of MINRES; the corrections extend the subspace. Leading pairs whose residual reaches
double precision are locked. Driver and closures hold vectors of one component count and a
subspace of bounded width, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofleet.llm.common import saved, shuffle_partitions, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Ritz pairs improved beyond the wanted ones, so that none is missed.
GUARD = 4
INNER = 6
MOST_OUTER = 500
#: A subspace of more columns than this many blocks is restarted with the leading RESTART blocks.
WIDEST, RESTART = 5, 2
#: Residual at which a pair is locked, against the largest eigenvalue.
TOLERANCE = 1e-14
#: Eigenvalues under this share of the trace are zero.
ZERO = 1e-12
BLOCK_ROWS = 1 << 12
#: Partial sums that the driver adds up; more are added up in tasks before.
PARTIALS = 256

Product = Callable[[np.ndarray], np.ndarray]


def minres(product: Product, shift: np.ndarray, b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of (A - shift_j) x_j = b_j for all columns, one product a step."""
    x = np.zeros_like(b)
    beta = np.linalg.norm(b, axis=0)
    live = beta > 0
    v, old = b / np.where(live, beta, 1), np.zeros_like(b)
    w, w_old = np.zeros_like(b), np.zeros_like(b)
    c = c_old = np.ones_like(beta)
    s = s_old = np.zeros_like(beta)
    eta = beta.copy()
    for _ in range(steps):
        av = product(v) - shift * v
        alpha = np.einsum("ij,ij->j", v, av)
        new = av - alpha * v - beta * old
        beta_new = np.linalg.norm(new, axis=0)
        delta = c * alpha - c_old * s * beta
        rho1 = np.hypot(delta, beta_new)
        rho2, rho3 = s * alpha + c_old * c * beta, s_old * beta
        safe = np.where(rho1 > 0, rho1, 1)
        w_new = np.where(rho1 > 0, (v - rho3 * w_old - rho2 * w) / safe, 0)
        c_old, c = c, np.where(rho1 > 0, delta / safe, 1)
        s_old, s = s, np.where(rho1 > 0, beta_new / safe, 0)
        x += c * eta * w_new
        eta = -s * eta
        w_old, w = w, w_new
        old, v, beta = v, np.where(beta_new > 0, new / np.where(beta_new > 0, beta_new, 1), 0), beta_new
    return x


def _orthonormal(t: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of ``t`` add to ``basis``."""
    for _ in range(2):
        size = np.linalg.norm(t, axis=0)
        t = t[:, size > 0] / size[size > 0]
        t = t - basis @ (basis.T @ t)
    if not t.shape[1]:
        return t
    u, size, _ = np.linalg.svd(t, full_matrices=False)
    u = u[:, (size > 1e-8) & (np.arange(len(size)) < basis.shape[0] - basis.shape[1])]
    for _ in range(2):
        u = np.linalg.qr(u - basis @ (basis.T @ u))[0] if u.shape[1] else u
    return u


def jacobi_davidson(product: Product, dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors of a symmetric operator."""
    rng = np.random.default_rng(dim)
    block = min(dim, wanted + GUARD)
    none = np.zeros((dim, 0))
    locked, values = none, np.zeros(0)
    v = _orthonormal(rng.standard_normal((dim, block)), none)
    av = product(v)
    scale, best, stalled = 0.0, np.inf, 0
    for _ in range(MOST_OUTER):
        h = v.T @ av
        theta, rotation = np.linalg.eigh((h + h.T) / 2)
        theta, rotation = theta[::-1], rotation[:, ::-1]
        v, av = v @ rotation, av @ rotation
        left = wanted - len(values)
        residual = av - v * theta
        size = np.linalg.norm(residual, axis=0)
        scale = max(scale, float(np.abs(theta).max(initial=0)))
        full = v.shape[1] + locked.shape[1] == dim
        # Rounding in sums over all rows sets a floor; a pair that stopped improving near it is as good as it gets.
        worst = float(size[:left].max(initial=0))
        best, stalled = (worst, 0) if worst < best / 2 else (best, stalled + 1)
        at_floor = (full or stalled >= 3) and worst <= 100 * TOLERANCE * scale
        done = (size[:left] <= TOLERANCE * scale) | at_floor
        many = left if done.all() else int(np.argmin(done))
        if many:
            locked, values = np.concatenate([locked, v[:, :many]], 1), np.concatenate([values, theta[:many]])
            v, av, theta, residual, best, stalled = v[:, many:], av[:, many:], theta[many:], residual[:, many:], np.inf, 0
        left = wanted - len(values)
        if left <= 0:
            order = np.argsort(-values, kind="stable")
            return values[order], locked[:, order]
        if full:
            raise ArithmeticError(f"the residual stays at {worst:.3g} of {scale:.3g}: products are not symmetric")
        block = min(left + GUARD, v.shape[1])
        if v.shape[1] + block > WIDEST * (wanted + GUARD):
            keep = RESTART * (wanted + GUARD)
            v = _orthonormal(v[:, :keep], locked)
            av = product(v)
            continue
        around = np.concatenate([locked, v[:, :block]], 1)

        def projected(x):
            y = product(x)
            return y - around @ (around.T @ y)

        right = residual[:, :block] - around @ (around.T @ residual[:, :block])
        t = minres(projected, theta[:block], -right, min(INNER, max(1, dim - around.shape[1])))
        t = _orthonormal(t, np.concatenate([locked, v], 1))
        if not t.shape[1]:
            t = _orthonormal(rng.standard_normal((dim, block)), np.concatenate([locked, v], 1))
        v, av = np.concatenate([v, t], 1), np.concatenate([av, product(t)], 1)
    raise ArithmeticError(f"{wanted - len(values)} of {wanted} pairs did not reach double precision")


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - sums, exact: 64-bit where that holds it, else Python integers."""
    base = np.array([int(s) // n for s in sums], object)
    rest = np.array([int(s) % n for s in sums], object)
    low = (x - base.astype(np.int64)) if all(abs(int(b)) < 1 << 62 for b in base) and np.abs(x).max(initial=0) < 1 << 62 else x.astype(object) - base
    if low.dtype != object and int(np.abs(low).max(initial=0) + 1) * n < 1 << 62:
        return low * n - rest.astype(np.int64)
    return low.astype(object) * n - rest


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(n: int, sums: list[int], dim: int):
    """Rows (x) as blocks of deviations from the mean, in doubles."""
    sums = np.array(sums, object)

    def task(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                d = deviations(_matrix(b.column("x").slice(at, BLOCK_ROWS), dim), n, sums)
                yield pa.RecordBatch.from_arrays([pa.array([(d / n).astype(np.float64).tobytes()], pa.binary())], ["rows"])

    return task


class Centred:
    """The deviations of a fit list as written blocks, and sums of products over them."""

    def __init__(self, blocks: DataFrame, n: int, dim: int):
        self.blocks, self.n, self.dim = blocks.select("rows", F.spark_partition_id().alias("slot")), n, dim
        self.slots = None

    def sums(self, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
        """Sum of ``of(rows)`` over all blocks; always in the same order."""
        dim = self.dim

        def partial(batches):
            total, slot = np.zeros(shape), 0
            for b in batches:
                for row, slot in zip(b.column("rows"), b.column("slot")):
                    total += of(np.frombuffer(row.as_py(), np.float64).reshape(-1, dim))
                    slot = slot.as_py()
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "total"])

        def merged(batches):
            total, slot = np.zeros(shape), None
            for b in batches:
                for part, one in zip(b.column("total"), b.column("slot")):
                    total += np.frombuffer(part.as_py(), np.float64).reshape(shape)
                    slot = one.as_py() if slot is None else slot
            if slot is not None:
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["slot", "total"])

        schema = "slot int, total binary"
        parts = self.blocks.mapInArrow(partial, schema)
        if self.slots is None:
            self.slots = (self.blocks.agg(F.max("slot")).first()[0] or 0) + 1
        if self.slots > PARTIALS:
            parts = parts.repartition(PARTIALS // 4, "slot").sortWithinPartitions("slot").mapInArrow(merged, schema)
        total = np.zeros(shape)
        for row in sorted(parts.collect(), key=lambda r: r["slot"]):
            total += np.frombuffer(row["total"], np.float64).reshape(shape)
        return total

    def product(self, u: np.ndarray) -> np.ndarray:
        """The covariance times ``u``."""
        return self.sums(lambda c: c.T @ (c @ u), u.shape) / self.n

    def trace(self) -> float:
        return float(self.sums(lambda c: np.array([np.einsum("ij,ij->", c, c)]), (1,))[0]) / self.n

    def identity_error(self, scaled: np.ndarray) -> float:
        """Largest entry of the covariance of the rows times ``scaled`` that is off the identity."""
        k = scaled.shape[1]
        cov = self.sums(lambda c: (c @ scaled).T @ (c @ scaled), (k, k)) / self.n
        return float(np.abs(cov - np.eye(k)).max())


def _whitened(n: int, sums: list[int], dim: int, scaled: np.ndarray, explained: np.ndarray, error: float):
    """Rows (vec_id, x) by component."""
    sums, k = np.array(sums, object), scaled.shape[1]

    def task(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK_ROWS):
                part = b.slice(at, BLOCK_ROWS)
                d = deviations(_matrix(part.column("x"), dim), n, sums)
                if d.dtype == object or float(np.abs(d.astype(float)).max(initial=0)) ** 2 * dim >= 2.0**62:
                    squares = [sum(int(y) ** 2 for y in row) for row in d]
                    if max(squares, default=0) >= 1 << 63:
                        raise ArithmeticError("a deviation doesn't fit a 64-bit integer")
                else:
                    squares = np.einsum("ij,ij->i", d, d)
                m = part.num_rows
                cols = [
                    part.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), pa.array(np.repeat(np.array(squares, np.int64), k)),
                    pa.array(((d / n).astype(np.float64) @ scaled).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in WHITENED.split(", ")])

    return task


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _space(rows: DataFrame, dim: int, components: int) -> DataFrame | None:
    """The whitened rows of one vector length, or None where nothing varies."""
    spark: SparkSession = rows.sparkSession
    fit = saved(rows.select("x").distinct())
    per = fit.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n")).collect()
    n, sums = per[0]["n"], [int(r["total"]) for r in sorted(per, key=lambda r: r["at"])]
    spread = fit.repartition(shuffle_partitions(spark)).mapInArrow(_centred(n, sums, dim), "rows binary")
    centred = Centred(saved(spread), n, dim)
    trace = centred.trace()
    if trace <= 0:
        return None
    values, vectors = jacobi_davidson(centred.product, dim, min(components, dim))
    on = values > ZERO * trace
    values, vectors = values[on], vectors[:, on]
    vectors = vectors * np.where(np.take_along_axis(vectors, np.abs(vectors).argmax(axis=0)[None], 0) < 0, -1, 1)
    scaled = vectors / np.sqrt(values)
    return rows.mapInArrow(_whitened(n, sums, dim, scaled, values / trace, centred.identity_error(scaled)), WHITENED)


def whitened(rows: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per row and component.

    Rows whose vector is null, empty or holds null or non-finite entries are dropped; a null id
    stays null. Equal vectors count once in the fit and give equal rows; repeated rows give
    repeated rows. Vectors of different lengths are fitted apart. Components of no variance
    (fewer distinct vectors than components, constant tables) are not returned, so a table
    of one distinct vector, like an empty one, gives no rows. Other columns are ignored. An
    entry or deviation beyond a long is an error.
    """
    spark = rows.sparkSession
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    in_range = F.forall("v", lambda x: F.abs(x) < 2.0**56)
    every = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.when(fine, v).alias("v")).filter("v IS NOT NULL")
    x = F.when(in_range, F.transform("v", lambda c: F.floor(SCALE * c) + OFFSET)).otherwise(F.raise_error(F.lit("an entry doesn't fit a 64-bit integer")).cast("array<long>"))
    every = saved(every.select("vec_id", x.alias("x"), F.size("v").alias("dim")))
    parts = []
    for row in sorted(every.select("dim").distinct().collect()):
        part = _space(every.filter(F.col("dim") == row["dim"]).select("vec_id", "x"), row["dim"], components)
        if part is not None:
            parts.append(part)
    out = spark.createDataFrame([], WHITENED)
    for part in parts:
        out = part if out is None or len(parts) == 1 else out.union(part)
    return out


def query(spark, sf_dir):
    return whitened(table(spark, sf_dir, "embeddings"))


SQL = None
