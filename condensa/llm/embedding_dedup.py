"""Near-duplicate vectors by counting collisions of one-dimensional projections, with an exact check.

Vectors are scaled to length 1 and projected on random Gaussian directions. A pair at the wanted cosine is a known
distance d apart, so its projections differ by a normal of deviation d and fall in a query-centred window of half
width WINDOW x d with known probability. The least count of collisions that keeps the wanted recall of such pairs
follows from the binomial law; pairs that pass it are verified by their cosine in double precision.

Vectors are cut into blocks along the first projection; only blocks within FAR x d of each other on it can hold a
link. A pair of blocks counts its collisions in memory, all projections' windows of all its vectors at once, and gives
link counts per vector and a spanning forest of its links, never its pairs. Work grows with the square of the number of
distinct vectors, as collisions do: a random pair falls into a window with a fixed probability, whatever the sort order,
so sorting each projection and walking its windows would meet the same pairs one by one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, lean, staged

SIMILARITY = 0.95
PROJECTIONS, WINDOW, FAR = 24, 2.0, 5.0
RECALL = 1 - 1e-5
BLOCK, TILE = 2048, 512
#: Slots of the first projection to a unit of it.
SLOTS = 512


def directions(dim: int, m: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng([20240607, dim]).normal(size=(dim, m))


def least_count(m: int = PROJECTIONS, window: float = WINDOW, recall: float = RECALL) -> int:
    """The largest count that a pair at the threshold reaches with that probability."""
    p = math.erf(window / math.sqrt(2))
    tail, c = 0.0, m
    while c > 0:
        tail += math.comb(m, c) * p**c * (1 - p) ** (m - c)
        if tail >= recall:
            return c
        c -= 1
    return 0


def unit(values: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by their largest component first so that nothing overflows."""
    scaled = values / np.abs(values).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _read(batches):
    """vec_id, key (null where the vector links with nothing), dim, place on the first projection, values."""
    for batch in batches:
        keys, dims, places, blobs = [], [], [], []
        for x in batch.column("embedding"):
            v = None
            if x.is_valid and len(x) and x.values.null_count == 0:
                v = x.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
                v = v if np.isfinite(v).all() and v.any() else None
            if v is None:
                keys.append(None), dims.append(None), places.append(None), blobs.append(None)
            else:
                blob = v.tobytes()
                keys.append(hashlib.blake2b(blob, digest_size=16).digest()), dims.append(len(v)), blobs.append(blob)
                places.append(float((unit(v[None]) @ _first(len(v)))[0]))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(places, pa.float64()), pa.array(blobs, pa.binary())], names=["vec_id", "key", "dim", "place", "blob"])


_firsts: dict[int, np.ndarray] = {}


def _first(dim: int) -> np.ndarray:
    if dim not in _firsts:
        _firsts[dim] = directions(dim)[:, 0]
    return _firsts[dim]


def _pack(batches):
    """Blocks as three byte strings: ids, copies, and vectors."""
    for batch in batches:
        rows = [(x["dim"], x["block"], x["low"], x["high"], *zip(*((m["rep"], m["copies"], m["blob"]) for m in x["members"]))) for x in batch.to_pylist()]
        yield pa.RecordBatch.from_pydict(
            {"dim": pa.array([r[0] for r in rows], pa.int32()), "block": pa.array([r[1] for r in rows], pa.int64()), "low": pa.array([r[2] for r in rows], pa.float64()), "high": pa.array([r[3] for r in rows], pa.float64()),
             "ids": pa.array([np.array(r[4], "<i8").tobytes() for r in rows], pa.binary()), "copies": pa.array([np.array(r[5], "<i8").tobytes() for r in rows], pa.binary()), "vectors": pa.array([b"".join(r[6]) for r in rows], pa.binary())}
        )


def forest(grid: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    fresh, out = np.ones(len(grid), bool), []
    for seed in np.flatnonzero(grid.any(1)):
        if fresh[seed]:
            fresh[seed], queue = False, [seed]
            while queue:
                at = queue.pop()
                new = np.flatnonzero(grid[at] & fresh)
                fresh[new] = False
                queue.extend(new.tolist())
                out.extend((int(at), int(x)) for x in new)
    return out


#: A projection in steps of 1 / STEPS, modulo 256: enough for the window, and wrapping only adds candidates.
STEPS = 28


def _near(a: np.ndarray, b: np.ndarray, steps_a: np.ndarray, steps_b: np.ndarray, width: int, count: int, least: float) -> np.ndarray:
    """Which pairs of two tiles collide often enough and then have that cosine."""
    shape = (len(a), len(b))
    hits, gap, inside = np.zeros(shape, np.uint8), np.empty(shape, np.uint8), np.empty(shape, bool)
    for x, y in zip(steps_a, steps_b):
        np.subtract(x[:, None], (y - np.uint8(width))[None, :], out=gap)
        np.less_equal(gap, np.uint8(2 * width), out=inside)
        np.add(hits, inside.view(np.uint8), out=hits)
    x, y = np.nonzero(hits >= count)
    good = np.zeros(shape, bool)
    for i in range(0, len(x), 16384):
        p, q = x[i : i + 16384], y[i : i + 16384]
        good[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= least
    return good


def _count(least: float):
    d = math.sqrt(2 - 2 * least)
    width, count = math.ceil(WINDOW * d * STEPS) + 1, least_count()

    def run(batches):
        for batch in batches:
            for row in (batch.slice(i, 1).to_pylist()[0] for i in range(batch.num_rows)):
                dim, sides, along = row["dim"], [], directions(row["dim"])
                for s in "ab":
                    ids, copies = (np.frombuffer(row[f"{c}_{s}"], "<i8") for c in ("ids", "copies"))
                    vectors = unit(np.frombuffer(row[f"vectors_{s}"], np.float64).reshape(len(ids), dim))
                    sides.append((ids, copies, vectors, np.ascontiguousarray(np.floor(vectors @ along * STEPS).astype(np.int64).astype(np.uint8).T)))
                (ia, na, va, pa_), (ib, nb, vb, pb) = sides
                same = row["a"] == row["b"]
                grid = np.zeros((len(ia), len(ib)), bool)
                for x in range(0, len(ia), TILE):
                    for y in range(x if same else 0, len(ib), TILE):
                        s, t = slice(x, x + TILE), slice(y, y + TILE)
                        grid[s, t] = _near(va[s], vb[t], pa_[:, s], pb[:, t], width, count, least)
                if same:
                    grid |= grid.T
                    np.fill_diagonal(grid, False)
                    ids, degree = ia, grid @ na
                    square = grid
                else:
                    ids, degree = np.r_[ia, ib], np.r_[grid @ nb, grid.T @ na]
                    some = np.flatnonzero(degree)  # the others have no link here
                    k = int((some < len(ia)).sum())
                    square = np.zeros((len(some),) * 2, bool)
                    square[:k, k:] = grid[np.ix_(some[:k], some[k:] - len(ia))]
                    square |= square.T
                    ids, degree = ids[some], degree[some]
                edges, some = forest(square), np.flatnonzero(degree)
                u = np.r_[ids[some], ids[[e[0] for e in edges]]] if edges else ids[some]
                v = [None] * len(some) + [int(ids[e[1]]) for e in edges]
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(np.r_[degree[some], np.zeros(len(edges), np.int64)], pa.int64())], names=["u", "v", "links"])

    return run


def near_duplicates(vectors: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    n_links counts the other rows with cosine >= least, component_id is the smallest vec_id reachable over such links,
    kept is vec_id = component_id. Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different dimension don't link. Equal vectors are one class with a number of copies, so a
    common vector is compared once. Rows that repeat a vec_id count as rows of their own in n_links and share their
    component. Rows with a null vec_id link with nothing (component_id null, kept). An empty table gives an empty table.
    """
    lean(vectors.sparkSession)
    read = staged(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(_read, "vec_id long, key binary, dim int, place double, blob binary"), "vectors-read")
    usable = read.where("key is not null and vec_id is not null")
    classes = usable.groupBy("key", "dim").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("place").alias("place"), F.first("blob").alias("blob"))
    classes = staged(classes, "vectors-classes")
    # Blocks along the first projection: small slots of it are joined in order, a large one is dealt out by hash (its
    # vectors lie within one slot's width whatever their order), so no slot is sorted or held by one task.
    binned = classes.withColumn("slot", F.floor(F.col("place") * SLOTS))
    sums = staged(binned.groupBy("dim", "slot").agg(F.count("*").alias("n")), "vectors-slots")
    before = Window.partitionBy("dim").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    few = F.col("n") <= BLOCK // 2
    ahead = F.coalesce(F.sum(F.when(few, F.col("n")).otherwise(0)).over(before), F.lit(0))
    sums = sums.select("dim", "slot", few.alias("few"), F.floor(ahead / BLOCK).alias("shared"), F.ceil(F.col("n") / BLOCK).alias("parts"))
    own = (F.col("slot") + (1 << 20)) * (1 << 20) + F.pmod(F.xxhash64("rep"), F.col("parts"))
    ranked = binned.join(sums, ["dim", "slot"]).withColumn("block", F.when(F.col("few"), F.col("shared") * 2).otherwise(own * 2 + 1))
    gathered = ranked.groupBy("dim", "block").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.collect_list(F.struct("rep", "copies", "blob")).alias("members"))
    blocks = gathered.mapInArrow(_pack, "dim int, block long, low double, high double, ids binary, copies binary, vectors binary")
    blocks = staged(blocks.withColumn("block", F.col("block") * (1 << 20) + F.col("dim")), "vectors-blocks")

    # Blocks that lie within `far` of each other on the first projection, by the bins of that width they reach.
    far = FAR * math.sqrt(2 - 2 * least)
    reach = lambda low, high: F.explode(F.sequence(F.floor(low / far), F.floor(high / far)))
    left = blocks.select("dim", F.col("block").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"), reach(F.col("low"), F.col("high")).alias("bin"))
    right = blocks.select("dim", F.col("block").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"), reach(F.col("low") - far, F.col("high") + far).alias("bin"))
    pairs = left.join(right, ["dim", "bin"]).where((F.col("a") <= F.col("b")) & (F.col("b_low") - F.col("a_high") <= far) & (F.col("a_low") - F.col("b_high") <= far)).select("a", "b").distinct()
    held = ["ids", "copies", "vectors"]
    a = blocks.select(F.col("block").alias("a"), "dim", *(F.col(c).alias(f"{c}_a") for c in held))
    b = blocks.select(F.col("block").alias("b"), *(F.col(c).alias(f"{c}_b") for c in held))
    found = staged(pairs.join(a, "a").join(b, "b").mapInArrow(_count(least), "u long, v long, links long"), "vectors-links")

    degree = found.groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    known = components(found.where("v is not null").select("u", "v"), "vectors-components").withColumnRenamed("node", "rep")
    told = classes.select("key", "dim", "rep", "copies").join(degree, "rep", "left").join(known, "rep", "left")
    told = told.select("key", F.col("dim").alias("d"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("of"))
    rows = read.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("key")).alias("key"), "dim").join(told, "key", "left")
    of = F.coalesce("of", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), of.alias("component_id"), F.coalesce(F.col("vec_id") == of, F.lit(True)).alias("kept"))
