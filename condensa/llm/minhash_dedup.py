"""Near-duplicate documents by ProbMinHash signatures of weighted shingles, banding and exact verification.

Five-word shingles of the lower-cased text, split at ASCII white space, weigh 1 + ln(occurrences). Each shingle is
a Poisson process whose rate is its weight: arrivals fall into random registers, a register keeps the element of its
first arrival, and an element stops once its time passes the latest of all registers. Two registers agree with the
probability Jaccard of the weighted sets. A second signature has all weights 1: its registers agree with the Jaccard of
the shingle sets, whatever repeats. Pairs that share a band of either are verified by that exact Jaccard, 0.8 or more.

Hot groups: documents with equal shingle sets are one class before banding. The members of all buckets with the same
smallest member, the pivot, form a group, dealt into blocks. A group of one block is compared as it is. In a larger one
every member is first compared with the pivot alone: one that is alike hangs together with it, and needs no more. The
others, which are few in a group of near copies, are then compared with all members, a pair of blocks at a time, by
matrix products. Blocks give the links of a spanning forest,
not all pairs, and no connection is lost: a pair of members that are both alike the pivot is connected through it, and
of every other pair one is among the others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, components, lean, mix, shingles, slices, staged, utf8, word_bounds, word_hashes, _power

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
#: A block holds about so many documents and bytes of shingles.
BLOCK_ROWS, BLOCK_BYTES = 512, 8 << 20
#: Up to so many bytes of keys are sent to the scan of the texts; with more, both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, occurrences) of the distinct shingles, sorted by row and hash."""
    data, offsets = utf8(pc.utf8_lower(pc.fill_null(texts, "")))
    starts, _, rows = word_bounds(data, offsets)
    found, rows = shingles(word_hashes(data, starts), rows, k)
    order = np.lexsort((found, rows))
    found, rows = found[order], rows[order]
    first = np.flatnonzero(np.r_[True, (found[1:] != found[:-1]) | (rows[1:] != rows[:-1])]) if len(found) else np.zeros(0, int)
    return found[first], rows[first], np.diff(np.append(first, len(found)))


def prob_minhash(elements: np.ndarray, weights: np.ndarray, rows: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """n_rows x m signatures: the element that arrives first in each register; 0 in rows without elements."""
    best, who = np.full(n_rows * m, np.inf), np.zeros(n_rows * m, U64)
    live, time, turn = np.arange(len(elements)), np.zeros(len(elements)), np.zeros(1, U64)
    while len(live):
        turn += U64(1)
        draw = mix(elements[live] + turn * U64(0xD1342543DE82EF95))
        time[live] -= np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[live]
        at, now = rows[live] * m + (mix(draw) % U64(m)).astype(np.int64), time[live]
        np.minimum.at(best, at, now)
        first = best[at] == now
        who[at[first]] = elements[live[first]]
        row = rows[live]
        change = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        last = np.repeat(best.reshape(n_rows, m)[row[change]].max(1), np.diff(np.append(change, len(row))))
        live = live[now < last]
    return who.reshape(n_rows, m)


def _sliced_sets(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets of a batch, made from smaller slices."""
    out, at = [], 0
    for piece in slices(part, "text"):
        found, rows, times = shingle_sets(piece.column("text"))
        out.append((found, rows + at, times))
        at += piece.num_rows
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))


def _sign(bands: int, per_band: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                n = part.num_rows
                found, rows, times = _sliced_sets(part)
                size = np.bincount(rows, minlength=n)
                plain = prob_minhash(found, np.ones(len(found)), rows, n, bands * per_band)
                weighted, again = plain.copy(), np.zeros(n, bool)
                again[rows[times > 1]] = True  # without repeats both signatures are the same
                part_of = again[rows]
                weighted[again] = prob_minhash(found[part_of], 1 + np.log(times[part_of]), (np.cumsum(again) - 1)[rows[part_of]], int(again.sum()), bands * per_band)
                code = np.concatenate([weighted.reshape(n, bands, per_band), plain.reshape(n, bands, per_band)], 1)
                keys = mix((code * _power(per_band + 1)[1 : per_band + 1]).sum(2, dtype=U64) ^ mix(np.arange(2 * bands, dtype=U64) + U64(99)))
                twin = np.zeros((2, n), U64)
                some = np.flatnonzero(size)
                if len(some):
                    first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
                    for i, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
                        twin[i, some] = np.add.reduceat(mix(found ^ U64(salt)), first)
                ends = np.cumsum(np.where(size > 0, 2 * bands, 0))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(keys[some].reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), part.column("doc_id"), part.column("digest"), pa.array(twin[0].view(np.int64)), pa.array(twin[1].view(np.int64)), pa.array(size, pa.int64()), lists], names=["row", "doc_id", "digest", "twin_a", "twin_b", "n", "bands"]
                )

    return run


_KEYS = "array<struct<u: long, i: int, j: int, side: int>>"


def _keyed_sets(batches):
    """(u, i, j, side, doc_id, shingles) for every key of a document."""
    for batch in batches:
        for part in slices(batch, "text"):
            found, rows, _ = shingle_sets(part.column("text"))
            ends = 8 * np.r_[0, np.cumsum(np.bincount(rows, minlength=part.num_rows))]
            blob = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(found.tobytes())]).cast(pa.binary())
            keys = part.column("keys")
            of = pc.list_parent_indices(keys)
            u, i, j, side = pc.list_flatten(keys).flatten()
            yield pa.RecordBatch.from_arrays([u, i, j, side, part.column("doc_id").take(of), blob.take(of)], names=["u", "i", "j", "side", "doc_id", "shingles"])


def _links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Links that hold together whatever Jaccard >= least joins, across the two sides where there are two, else among all.

    With one row on a side each such link is given.

    Intersections are matrix products over the shingles that occur more than once, so many columns at a time.
    """
    n = len(ids)
    size = np.array([len(x) for x in sets])
    value, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), size)
    shared = times > 1
    renamed = np.cumsum(shared) - 1
    row, column = row[shared[column]], renamed[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if side.any() and not side.all() else (np.arange(n),) * 2
    both = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), 4096):
        a, b = np.searchsorted(column, (start, start + 4096))
        bits = np.zeros((n, 4096), np.float32)
        bits[row[a:b], column[a:b] - start] = 1
        both += bits[left] @ bits[right].T
    near = both >= least * (size[left][:, None] + size[right][None, :] - both) - 1e-6
    grid = np.zeros((n, n), bool)
    grid[np.ix_(left, right)] = near
    grid |= grid.T
    np.fill_diagonal(grid, False)
    fresh, out = np.ones(n, bool), []
    for seed in range(n):
        if not fresh[seed] or not grid[seed].any():
            continue
        fresh[seed], queue = False, [seed]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(grid[at] & fresh)
            fresh[new] = False
            queue.extend(new.tolist())
            out.extend((int(ids[at]), int(ids[x])) for x in new)
    return out


def _compare(least: float):
    def run(batches):
        key, ids, sets, side = None, [], [], []

        def done():
            found = _links(np.array(ids), sets, np.array(side), least)
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["k", "u", "v"])

        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("u", "i", "j"))))
            for k, d, s, blob in zip(names, batch.column("doc_id").to_pylist(), batch.column("side").to_pylist(), batch.column("shingles")):
                if k != key:
                    if len(ids) > 1:
                        yield done()
                    key, ids, sets, side = k, [], [], []
                ids.append(d)
                side.append(s)
                sets.append(np.frombuffer(blob.as_buffer(), U64))
        if len(ids) > 1:
            yield done()

    return run


def _digest(column: str):
    return F.md5(F.col(column).cast("binary"))


def _grouped(docs: DataFrame, least: float, bands: int, per_band: int) -> DataFrame:
    """(doc_id, digest of the text, n shingles, first_id, first_digest) of every row; the last two, of the row that stands for
    its group: the one of smallest doc_id, of several with that the one of smallest digest."""
    lean(docs.sparkSession)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), _digest("text").alias("digest"), "text")
    signed = staged(rows.mapInArrow(_sign(bands, per_band), "row long, doc_id long, digest string, twin_a long, twin_b long, n long, bands array<long>"), "minhash-signed")
    named = signed.where("n > 0 and doc_id is not null")
    twins = named.groupBy("twin_a", "twin_b", "n").agg(F.min(F.struct("doc_id", "digest", "row")).alias("rep"))
    twins = staged(twins.select("twin_a", "twin_b", "n", F.col("rep.row").alias("rep"), F.col("rep.doc_id").alias("rep_id"), F.col("rep.digest").alias("rep_digest")), "minhash-twins")
    reps = named.join(twins, ["twin_a", "twin_b", "n"]).where("row = rep").select("rep", "n", F.explode("bands").alias("band"))
    buckets = reps.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("size")).where("size > 1").drop("size")
    groups = reps.join(buckets, "band").select(F.col("pivot").alias("u"), F.col("rep").alias("v"), "n").distinct()
    groups = staged(groups, "minhash-groups")
    # A group's members are dealt into blocks by hash; a block, or a pair of blocks, is one unit of work of bounded size.
    many = lambda: F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") * 8 / BLOCK_BYTES)).cast("int")
    blocks = groups.groupBy("u").agg(many().alias("blocks"))
    blocks = staged(blocks, "minhash-blocks")  # so that the members of a large group can be dealt to several tasks
    placed = staged(groups.join(blocks, "u").withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")), "minhash-placed")
    key = lambda i, j, side: F.struct("u", F.expr(i).cast("int").alias("i"), F.expr(j).cast("int").alias("j"), F.lit(side).alias("side"))

    def compared(keys: DataFrame, name: str) -> DataFrame:
        """(k, u, v): the links that the keyed documents (v, key) have with the other side of their keys' blocks, by group k."""
        keyed = staged(keys.groupBy(F.col("v").alias("rep")).agg(F.collect_list("key").alias("keys")).join(twins, "rep").select("rep", "rep_id", "rep_digest", "keys"), f"minhash-{name}-keyed")
        few = (keyed.select(F.sum(F.size("keys") * 24 + 64)).first()[0] or 0) <= BROADCAST_BYTES
        texts = docs.select(F.col("doc_id").cast("long"), _digest("text").alias("digest"), "text")
        texts = texts.join(F.broadcast(keyed) if few else keyed, (F.col("doc_id") == F.col("rep_id")) & (F.col("digest") == F.col("rep_digest"))).select(F.col("rep").alias("doc_id"), "text", "keys")
        sets = texts.mapInArrow(_keyed_sets, "u long, i int, j int, side int, doc_id long, shingles binary")
        return staged(sets.repartition("u", "i", "j").sortWithinPartitions("u", "i", "j").mapInArrow(_compare(least), "k long, u long, v long"), f"minhash-{name}-links")

    small = placed.where("blocks = 1").select("v", key("0", "0", 0).alias("key"))
    large = placed.where("blocks > 1 and v <> u")
    others = large.select("v", key("b", "-1", 0).alias("key"))
    pivots = blocks.where("blocks > 1").select("u", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")).select(F.col("u").alias("v"), key("b", "-1", 1).alias("key"))
    direct = compared(small.union(others).union(pivots), "direct")
    alike = direct.select(F.col("k").alias("u"), F.explode(F.array("u", "v")).alias("v")).distinct()
    missed = large.join(alike, ["u", "v"], "left_anti")
    missed = staged(missed, "minhash-missed")
    parts = staged(missed.groupBy("u").agg(many().alias("parts"), F.first("blocks").alias("blocks")), "minhash-parts")
    sided = missed.join(parts.drop("blocks"), "u").withColumn("p", F.pmod(F.xxhash64("v", F.lit(1)), F.col("parts")).cast("int"))
    left = sided.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("v", key("p", "o", 0).alias("key"))
    # The pivot has been compared with all.
    right = large.join(parts.drop("blocks"), "u").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("v", key("o", "b", 1).alias("key"))
    links = direct.select("u", "v")
    if not missed.isEmpty():  # else the texts need no second scan
        links = links.union(compared(left.union(right), "rest").select("u", "v"))
    known = components(links, "minhash-components")
    firsts = known.join(twins, known.node == twins.rep).groupBy("component").agg(F.min(F.struct("rep_id", "rep_digest")).alias("first"))
    firsts = staged(firsts, "minhash-firsts")
    known = known.join(firsts, "component").select("node", "first")
    classes = twins.join(known, twins.rep == known.node, "left").select("twin_a", "twin_b", "n", F.coalesce("first.rep_id", "rep_id").alias("first_id"), F.coalesce("first.rep_digest", "rep_digest").alias("first_digest"))
    classes = staged(classes, "minhash-classes")  # a join of two plain exchanges is one whose hot twins Spark can split
    return signed.drop("bands").join(classes, ["twin_a", "twin_b", "n"], "left").select("doc_id", "digest", "n", "first_id", "first_digest")


def near_duplicates(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, per_band: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, component_id (smallest doc_id of its group), kept (doc_id = component_id).

    Documents without words (null, empty or blank text) are alike to nothing. A text of fewer than five words has
    one shingle of all its words. Rows that repeat a doc_id are each judged by their own text. Rows with a null doc_id
    link with nothing: component_id null, kept. An empty table gives an empty table.
    """
    return (
        _grouped(docs, least, bands, per_band)
        .select("doc_id", F.when(F.col("n") > 0, F.col("first_id")).otherwise(F.col("doc_id")).alias("c"))
        .select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("c")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row of each group, the one of smallest doc_id (of several texts with that, the one of smallest md5).

    Rows are told apart by doc_id and text: of those equal in both one stays. Null ids stay.
    """
    gone = _grouped(docs, least, BANDS, ROWS).where("n > 0 and doc_id is not null and (doc_id <> first_id or digest <> first_digest)")
    gone = gone.select(F.col("doc_id").alias("gone"), F.col("digest").alias("gone_digest")).distinct()
    rows = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn("digest", _digest(f"c{docs.columns.index('text')}"))  # any names will do
    key = f"c{docs.columns.index('doc_id')}"
    stay = rows.where(F.col(key).isNotNull()).join(gone, (F.col(key) == F.col("gone")) & (F.col("digest") == F.col("gone_digest")), "left_anti").dropDuplicates([key, "digest"])
    return stay.union(rows.where(F.col(key).isNull())).drop("digest").toDF(*docs.columns)
