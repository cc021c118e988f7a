"""Whitening of embeddings: leading principal components by matrix-free block Lanczos, and every vector in them.

The covariance is never built. Each step multiplies it by a block of vectors in one pass over the fit list: a task sums
(x - mean) ((x - mean)' V) over its rows, the sums of one dimension meet by a group-by, and d x block numbers reach the
driver, which keeps the basis (d x basis numbers; d is the width of a vector, not the number of rows) and reorthogonalises
every new block against all of it, twice. Where a block breaks down, the directions that are lost are replaced by random
ones orthogonal to the basis; where the basis has reached its limit, the iteration restarts from its best Ritz vectors.
It ends when the residuals |A q - theta q| of all wanted pairs are at rounding level, or the basis spans everything.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, staged

COMPONENTS = 16
BLOCK = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, either sign, count as this: a double's whole numbers end here.
LARGEST = 1 << 53
#: Residuals of so much of the largest eigenvalue end the iteration; so many basis vectors, and steps, at most.
TOLERANCE, BASIS, STEPS = 1e-13, 512, 400
#: Components of less than this share of the largest eigenvalue are rounding noise, so there is nothing to scale.
LEAST_SHARE = 1e-10
_SPLIT = 26


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _levels(vectors: np.ndarray) -> np.ndarray:
    """x of finite entries c: floor(64 c) + 1000000 as whole numbers."""
    return np.clip(np.floor(vectors.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array<double>) and d of the rows whose vector is there, has entries, and all of them are finite."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where("embedding is not null and size(embedding) > 0")
    return kept.where(F.coalesce(finite, F.lit(False))).withColumn("d", F.size("embedding"))


def fit_list(rows: DataFrame, width: int) -> DataFrame:
    """x (array<bigint>) of every distinct vector of `rows` (embedding)."""

    def level(batches):
        for batch in batches:
            x = _levels(_matrix(batch.column("embedding"), width))
            cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([cells], names=["x"])

    return rows.select("embedding").mapInArrow(level, "x array<bigint>").groupBy("x").agg(F.lit(1).alias("one")).select("x")


def sums(fit: DataFrame, width: int) -> tuple[int, list[int]]:
    """n and the exact sum of every dimension. Sums are kept in two parts, so none overflows."""

    def part(batches):
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = _matrix(batch.column("x"), width)
            n, high, low = n + len(x), high + (x >> _SPLIT).sum(axis=0), low + (x & ((1 << _SPLIT) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)], names=["i", "n", "high", "low"])

    met = fit.mapInArrow(part, "i int, n long, high long, low long").groupBy("i").agg(F.sum("n"), F.sum("high"), F.sum("low")).collect()  # a row a dimension
    total = [0] * width
    for i, _, high, low in met:
        total[i] = (high << _SPLIT) + low
    return (met[0][1] if met else 0), total


class Centre:
    """n and sums of the fit list: centred vectors in doubles, deviations in whole numbers."""

    def __init__(self, n: int, total: list[int]):
        self.n, self.total = n, total
        self.whole = [s // n for s in total] if n else total
        self.base = np.array(self.whole, np.int64)
        self.rest = np.array([(s - n * w) / n for s, w in zip(total, self.whole)]) if n else np.zeros(len(total))
        self.left = np.array([s - n * w for s, w in zip(total, self.whole)], np.int64)

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n: the whole part is taken off in whole numbers, so large offsets cost no digits."""
        return (x - self.base) - self.rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over the dimensions of (n x - S)^2, exact; None where it is beyond 64 bits."""
        off = x - self.base
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            return ((self.n * off - self.left) ** 2).sum(axis=1).tolist()
        n, left = self.n, self.left.tolist()
        exact = (sum((n * a - b) ** 2 for a, b in zip(row, left)) for row in off.tolist())
        return [v if v < 1 << 63 else None for v in exact]


def _block_sums(fit: DataFrame, width: int, columns: int, work) -> np.ndarray:
    """Sum over all tasks of the matrices of `columns` columns that `work` makes of a task's batches; rows meet by their number."""

    def part(batches):
        out = None
        for batch in batches:
            made = work(_matrix(batch.column("x"), width))
            out = made if out is None else out + made
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out), dtype=np.int32)), *(pa.array(np.ascontiguousarray(out[:, j])) for j in range(columns))], names=["i", *(f"y{j}" for j in range(columns))])

    schema = "i int, " + ", ".join(f"y{j} double" for j in range(columns))
    met = fit.mapInArrow(part, schema).groupBy("i").agg(*(F.sum(f"y{j}").alias(f"y{j}") for j in range(columns))).collect()
    return np.array([row[1:] for row in sorted(met)], float).reshape(-1, columns)


def covariance_times(fit: DataFrame, centre: Centre, block: np.ndarray) -> np.ndarray:
    """The covariance of the fit list times a block, in one pass."""
    def work(x):
        c = centre.centred(x)
        return c.T @ (c @ block)

    return _block_sums(fit, len(block), block.shape[1], work) / centre.n


def _new_directions(block: np.ndarray, basis: np.ndarray, wanted: int, rng, scale: float) -> np.ndarray:
    """Orthonormal columns of `block` outside `basis`, made up to `wanted` by random ones where it breaks down."""
    d = len(block)
    wanted = min(wanted, d - basis.shape[1])
    kept = np.zeros((d, 0))
    for column in [*block.T, *(None for _ in range(4 * wanted))]:
        if kept.shape[1] >= wanted:
            break
        fresh = column is None
        v = rng.standard_normal(d) if fresh else column
        least = 1e-8 * np.linalg.norm(v) if fresh else 1e-12 * scale
        for _ in range(2):
            v = v - basis @ (basis.T @ v)
            v = v - kept @ (kept.T @ v)
        length = np.linalg.norm(v)
        if length > least:
            v = v / length  # once more after scaling: a small remainder has lost digits
            v = v - basis @ (basis.T @ v)
            v = v - kept @ (kept.T @ v)
            kept = np.column_stack([kept, v / np.linalg.norm(v)])
    return kept


def leading(times, width: int, wanted: int = COMPONENTS, block: int = BLOCK, tolerance: float = TOLERANCE, limit: int = BASIS, seed: int = 13) -> tuple[np.ndarray, np.ndarray, int]:
    """(eigenvalues falling, eigenvectors as columns, passes) of the symmetric map `times`, which is applied to whole blocks."""
    rng, wanted, limit = np.random.default_rng(seed), min(wanted, width), max(limit, 2 * (wanted + block))
    basis = image = np.zeros((width, 0))
    fresh = _new_directions(rng.standard_normal((width, min(block, width))), basis, block, rng, 1.0)
    for step in range(1, STEPS + 1):
        made = times(fresh)
        basis, image = np.column_stack([basis, fresh]), np.column_stack([image, made])
        small = basis.T @ image
        values, turns = np.linalg.eigh((small + small.T) / 2)
        values, turns = values[::-1], turns[:, ::-1]
        k = min(wanted, basis.shape[1])
        largest = max(abs(values[0]), np.finfo(float).tiny)
        residual = image @ turns[:, :k] - (basis @ turns[:, :k]) * values[:k]
        if basis.shape[1] == width or (k == wanted and np.linalg.norm(residual, axis=0).max() <= tolerance * largest):
            break
        if basis.shape[1] + block > limit:
            held = turns[:, : wanted + block]
            basis, image = basis @ held, image @ held
            made = image - basis * values[: wanted + block]
        fresh = _new_directions(made, basis, block, rng, largest)
    vectors, _ = np.linalg.qr(basis @ turns[:, :k])
    signs = np.sign(np.einsum("ij,ij->j", vectors, basis @ turns[:, :k]))
    return values[:k], vectors * signs, step


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null, NaN or infinite entries are left out. All vectors need one length:
    the commonest one counts (the longer of two as common), rows of other lengths are left out. Entries beyond 2^53 / 64
    count as that. Rows that repeat are each returned, and are one vector of the fit list; a null vec_id stays null.
    Components are those of at least LEAST_SHARE of the largest eigenvalue, `components` at most: where all vectors are
    equal there are none, and no rows. deviation is null where it is beyond 64 bits. An empty table gives an empty table.
    Extra columns play no part.
    """
    spark = lean(vectors.sparkSession)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = usable(vectors)
    common = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not common:
        return spark.createDataFrame([], schema)
    width = common[0]["d"]
    rows = rows.where(F.col("d") == width)
    fit = staged(fit_list(rows, width), "whitening-fit")
    n, total = sums(fit, width)
    centre = Centre(n, total)
    values, axes, _ = leading(lambda block: covariance_times(fit, centre, block), width, components)
    trace = float(_block_sums(fit, width, 1, lambda x: np.array([[np.square(centre.centred(x)).sum()]]))[0, 0]) / n
    there = values > max(values[0], 0.0) * LEAST_SHARE
    if not there.any():
        return spark.createDataFrame([], schema)
    values, axes = values[there], axes[:, there]
    weights, k = axes / np.sqrt(values), int(there.sum())

    def spread(x):
        w = centre.centred(x) @ weights
        return np.vstack([w.T @ w, w.sum(axis=0)])

    met = _block_sums(fit, width, k, spread)
    mean = met[k] / n
    error = float(np.abs(met[:k] / n - np.outer(mean, mean) - np.eye(k)).max())
    shares = values / trace

    def told(batches):
        for batch in batches:
            x = _levels(_matrix(batch.column("embedding"), width))
            w, m = centre.centred(x) @ weights, len(x)
            yield pa.RecordBatch.from_arrays([
                pc.take(batch.column("vec_id"), pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                pc.take(pa.array(centre.deviations(x), pa.int64()), pa.array(np.repeat(np.arange(m), k))), pa.array(w.ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
            ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "embedding").mapInArrow(told, schema)
