"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Weights of the sources in code point order, repeating.
CYCLE = (3, 1, 2)
BUDGET = 1.5
MOST = 2
#: Hex digits of the shuffle key that name a slice: 65,536 slices a source, each a task's worth even of a third of 100 TB.
SLICE_DIGITS = 4
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, budget: float = BUDGET, most: int = MOST, cycle: tuple = CYCLE) -> DataFrame:
    """(source, source_size, target) with the other columns of `sizes`, which has one row (source, source_size) per source.

    Sources in code point order, null last, weigh cycle[0], cycle[1], ... repeating. budget x all sizes is shared
    by weight; no target passes most x its source's size, and what is over goes to the others by weight until none
    is above. That fixed point is min(cap, level x weight); the level is found in one pass over the sources in
    order of cap / weight. No rows give no rows; sources of size 0 have target 0.
    """
    place = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    rest = by_cap.rowsBetween(0, Window.unboundedFollowing)
    done = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in cycle]), ((F.col("place") - 1) % len(cycle) + 1).cast("int"))
    return (
        sizes.withColumn("place", F.row_number().over(place))
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("level", (F.col("all") - F.coalesce(F.sum("cap").over(done), F.lit(0.0))) / F.sum("weight").over(rest))
        .withColumn("level", F.max(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.col("level"))).over(everything))
        .select(*sizes.columns, F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap")).alias("target"))
    )


def _edge(copies: DataFrame, limit: int) -> tuple[int, tuple | None]:
    """Where the ranked copies reach the limit: the first bin not wholly taken, and the last copy taken in it.

    Two levels of 4096 bins, so that what is put in one order is a slice of a slice.
    """
    ahead = 0
    for level in ("bin", "fine"):
        order = Window.orderBy(level).rowsBetween(Window.unboundedPreceding, 0)
        ends = copies.groupBy(level).agg(F.sum("size").alias("bin_size")).withColumn("end", F.lit(ahead) + F.sum("bin_size").over(order))
        cut = ends.where(F.col("end") > limit).orderBy(level).limit(1).collect()  # one row
        if not cut:
            return (1 << 62), None
        ahead, at = cut[0]["end"] - cut[0]["bin_size"], cut[0][level]
        first = at if level == "bin" else first
        copies = copies.where(F.col(level) == at)
    line = Window.orderBy("finish", "turn", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    held = copies.withColumn("end", F.lit(ahead) + F.sum("size").over(line)).where(F.col("end") <= limit)
    last = held.agg(F.max(F.struct("finish", "turn", "doc_id", "tie")).alias("edge")).first()["edge"]
    if last is None:  # the slice's first copy is too much: all before the slice is taken
        return first, (at / 4096.0 / 4096.0, "", None, None)
    return first, tuple(last)


def mix(docs: DataFrame, budget: float = BUDGET, most: int = MOST, cycle: tuple = CYCLE, whole: bool = False) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, copies, and with `whole` also row, the
    input row as a struct.

    Documents are shuffled by the md5 of their id. A document's copy in pass e (0 .. most - 1) has the virtual
    finish time (e x source_size + running tokens of its source) / target. All copies are ranked by finish time,
    then shuffle key, then doc_id, then a digest of the text, and taken while their running total stays within the total budget. Running sums
    have two levels: sums of slices, then inside a slice, so neither a hot source nor the global order is one task.

    size is the number of words (null text: 0); documents of size 0 add nothing and have taken 0. Rows that repeat
    a doc_id are mixed each on its own, in an order that their texts settle, so reruns agree; rows equal in all are alike. Null ids are shuffled as the word "null". An empty table gives
    an empty table.
    """
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if whole else []
    sized = docs.select(
        "doc_id", "source", *row,
        F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source")).alias("of"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary")).alias("turn"), F.xxhash64("text").alias("tie"),
    ).withColumn("slice", F.substring("turn", 1, SLICE_DIGITS))
    slim = staged(sized.groupBy("source", "of", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices")
    targets = source_targets(slim.groupBy("source", "of").agg(F.sum("slice_size").alias("source_size")), budget, most, cycle)
    # What is ahead of a slice: the coarser slices before its own, then the slices before it there; few rows a window.
    coarse = slim.groupBy("of", F.substring("slice", 1, SLICE_DIGITS // 2).alias("coarse")).agg(F.sum("slice_size").alias("coarse_size"))
    earlier = lambda key, order: Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.select("of", "coarse", F.coalesce(F.sum("coarse_size").over(earlier(["of"], "coarse")), F.lit(0)).alias("base")).join(targets.drop("source"), "of")
    inner = F.coalesce(F.sum("slice_size").over(earlier(["of", "coarse"], "slice")), F.lit(0))
    ahead = slim.withColumn("coarse", F.substring("slice", 1, SLICE_DIGITS // 2)).select("of", "coarse", "slice", inner.alias("inner")).join(coarse, ["of", "coarse"])
    ahead = ahead.withColumn("ahead", F.col("base") + F.col("inner")).drop("coarse", "base", "inner")
    inside = Window.partitionBy("of", "slice").orderBy("turn", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("run", F.sum("size").over(inside)).join(ahead, ["of", "slice"]).withColumn("run", F.col("ahead") + F.col("run")).drop("of", "slice", "ahead")
    queued = staged(queued, "mix-queued")
    limit = int((slim.agg(F.sum("slice_size")).first()[0] or 0) * budget)

    live = (F.col("size") > 0) & (F.col("target") > 0)
    finish = lambda e: F.try_divide((F.lit(e) * F.col("source_size") + F.col("run")).cast("double"), F.col("target"))
    bin_of = lambda x: F.floor(x * 4096).cast("long")
    copies = (
        queued.where(live)
        .select("doc_id", "turn", "tie", "size", F.explode(F.array(*[finish(e) for e in range(most)])).alias("finish"))
        .withColumn("bin", bin_of(F.col("finish")))
        .withColumn("fine", F.floor(F.col("finish") * (4096 * 4096)).cast("long"))
    )
    at, edge = _edge(copies, limit)

    def taken(e: int):
        inside = bin_of(finish(e)) < at
        if edge is not None:
            f, turn, doc_id, tie = edge
            same = F.col("doc_id").eqNullSafe(F.lit(doc_id)) & (F.col("tie") <= tie if tie is not None else F.lit(False))
            earlier = F.lit(False) if doc_id is None else F.col("doc_id").isNull() | (F.col("doc_id") < doc_id)
            before = (F.col("turn") < turn) | ((F.col("turn") == turn) & (earlier | same))
            inside |= (bin_of(finish(e)) == at) & ((finish(e) < f) | ((finish(e) == f) & before))
        return F.when(live & inside, 1).otherwise(0)

    number = sum((taken(e) for e in range(1, most)), taken(0))
    return queued.withColumn("copies", number).select("doc_id", "source", *(["row"] if whole else []), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of docs.

    Rows without words (null, empty or blank text) are taken never. Extra columns, whatever their names, come along.
    Repeated rows, null ids and sources, ties and empty tables as in `mix`.
    """
    taken = mix(docs, whole=True, **options).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
