"""Repeated passages by a sparse suffix array: any run of LEAST words that occurs before is found, wherever it begins.

Suffixes are kept at content-selected positions only: the minimisers, of every WINDOW consecutive five-word grams the
one with the smallest hash. The first window of a repeated passage of LEAST words chooses the same minimiser in
all its occurrences, so at least REACH = LEAST - WINDOW + 1 of its words follow that suffix's start. Suffixes
are sorted by the codes of their first REACH words, a byte each, then by a digest of those words, and each is compared
with its neighbours: one that has REACH words in common with neither is dropped, which leaves the repeated parts of the
corpus. (The order of codes is an order of words like any other; where two words share a code, the digest tells.) There, matches are extended to the left, to every word whose window
chose that suffix, and to the right, to LEAST words: occurrences of a suffix with equal runs around it match as a
whole; between those with different ones each run of LEAST words is compared by a 128-bit digest. Matches that follow each other
join to the longest one. The first occurrence stays. Copies of whole texts are set aside first.

Words are runs of other than ASCII white space, compared without ASCII case; offsets are code points of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, _power, gram_hashes, lean, mix, row_places, slices, staged, utf8, word_bounds, word_hashes

LEAST = 50
GRAM = 5
WINDOW = 25
REACH = LEAST - WINDOW + 1
#: Up to so many bytes of suffix places, and of copies of whole texts, are sent to the scan; with more, both sides are shuffled.
BROADCAST_BYTES = 32 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _words(texts: pa.Array):
    data, offsets = utf8(texts)
    starts, ends, rows = word_bounds(data, offsets)
    return data, offsets, starts, ends, rows, word_hashes(_LOWER[data], starts)


def minimisers(words: np.ndarray, rows: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, chosen word) of every window inside a row: the word that begins its smallest gram, leftmost of equals."""
    span = window + gram - 1
    if len(words) < span:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = gram_hashes(words, gram)[: len(words) - gram + 1]
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    begin = np.flatnonzero(rows[: len(view)] == rows[span - 1 : span - 1 + len(view)])
    chosen = [part + view[part].argmin(1) for part in (begin[i : i + (1 << 16)] for i in range(0, len(begin), 1 << 16))]
    return begin, np.concatenate([np.zeros(0, np.int64), *chosen])


def _long_hash(words: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of the k words from each word on, by differences of running sums of word x power (all modulo 2**64)."""
    mixed = mix(words ^ U64(salt))
    n = len(mixed)
    power = _power(n + 1)
    run = np.r_[U64(0), np.cumsum(mixed * power[:n][::-1])]
    sums = run[k:] - run[: n - k + 1]  # times power(n - i - 1), which differs by position: scale all to the same
    return mix(sums * _inverse(n)[: n - k + 1]) if n >= k else np.zeros(0, U64)


_inverses = np.ones(1, U64)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))


def _inverse(n: int) -> np.ndarray:
    """inverse[i] scales a sum over positions i, i + 1, ... in a text of n words so that it no longer depends on i."""
    global _inverses
    if len(_inverses) < n:
        grown = np.full(max(n, 2 * len(_inverses)), _BASE_INVERSE, U64)
        grown[0] = 1
        _inverses = np.multiply.accumulate(grown)
    return _inverses[:n][::-1]


def _suffixes(batches):
    """Of every kept suffix the codes and a digest of its first REACH words, and its place."""
    for batch in batches:
        for part in slices(batch, "text"):
            _, _, _, _, rows, words = _words(part.column("text"))
            at = np.unique(minimisers(words, rows)[1])
            place, size = row_places(rows)
            at = at[place[at] + REACH <= size[at]]
            key = _long_hash(words, REACH, 1)[at] if len(at) else np.zeros(0, U64)
            codes = (words >> U64(56)).astype(np.uint8)
            order = np.lib.stride_tricks.sliding_window_view(codes, REACH)[at] if len(at) else np.zeros((0, REACH), np.uint8)
            ends = np.arange(len(at) + 1, dtype=np.int32) * REACH
            blobs = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(order))])
            own = pa.array(rows[at])
            yield pa.RecordBatch.from_arrays([blobs, pa.array(key.view(np.int64)), part.column("doc_id").take(own), part.column("t").take(own), pa.array(place[at].astype(np.int32))], names=["codes", "key", "doc_id", "t", "place"])


def common(codes: np.ndarray) -> np.ndarray:
    """How many words each suffix has in common with the one before it, by rows of codes."""
    differ = codes[1:] != codes[:-1]
    return np.where(differ.any(1), differ.argmax(1), codes.shape[1])


def _neighbours(batches):
    """Of sorted suffixes, those equal to a neighbour, and the first and last of the partition, whose neighbours are elsewhere."""
    held = None
    first = True
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if batch.num_rows < 2:
            held = batch
            continue
        key, blobs = batch.column("key").to_numpy(), batch.column("codes")
        start = np.frombuffer(blobs.buffers()[1], np.int32)[blobs.offset]
        codes = np.frombuffer(blobs.buffers()[2], np.uint8)[start : start + REACH * batch.num_rows].reshape(-1, REACH)
        same = (common(codes) == REACH) & (key[1:] == key[:-1])
        keep = np.r_[first, same] | np.r_[same, False]
        if not first:  # what was held went through its left neighbour already
            keep[0] |= bool(carried)
        carried = bool(same[-1])
        held = batch.slice(batch.num_rows - 1)
        first = False
        yield batch.slice(0, batch.num_rows - 1).filter(pa.array(keep[:-1])).drop_columns(["codes"])
    if held is not None:
        yield held.drop_columns(["codes"])


def _placed(part: pa.RecordBatch):
    """Words of a batch with what follows from them, and the surviving suffixes of its column `places`."""
    data, offsets, starts, ends, rows, words = _words(part.column("text"))
    place, size = row_places(rows)
    begin = np.searchsorted(rows, np.arange(part.num_rows))
    lists = part.column("places")
    alive = np.zeros(len(words), bool)
    alive[begin[pc.list_parent_indices(lists).to_numpy()] + pc.list_flatten(lists).to_numpy()] = True
    character = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    shift = character[offsets[rows]]
    first, last = character[starts] - shift, character[ends] - shift  # of each word, in code points of its text
    s, at = minimisers(words, rows)
    whole = place[s] + LEAST <= size[s]
    s, at = s[whole], at[whole]
    live = alive[at]
    return rows, words, place, first, last, s[live], at[live]


def _groups(batches):
    """For every surviving suffix the runs of LEAST words that chose it: a digest of the first and last, place and offsets."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows, words, place, first, last, s, at = _placed(part)
            if not len(s):
                continue
            low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            high = np.r_[low[1:], len(at)] - 1
            lo, hi, p = s[low], s[high], at[low]
            key = _long_hash(words, REACH, 1)[p]
            back, width, kinds = (p - lo).astype(U64), (hi - lo).astype(U64), []
            for salt in (2, 3):
                run = _long_hash(words, LEAST, salt)
                kinds.append(mix(mix(mix(run[lo] ^ key) + run[hi] * U64(3)) + back * U64(64) + width).view(np.int64))
            cells = [key.view(np.int64), *kinds, (p - lo).astype(np.int32), (hi - lo).astype(np.int32), place[p].astype(np.int32), first[lo].astype(np.int32), last[hi + LEAST - 1].astype(np.int32)]
            own = pa.array(rows[p])
            yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("t").take(own), *map(pa.array, cells)], names=["doc_id", "t", "key", "a", "b", "back", "width", "place", "start", "end"])


def _runs(batches):
    """Digest and offsets of every run of LEAST words that chose a suffix in `places`."""
    for batch in batches:
        for part in slices(batch, "text"):
            rows, words, place, first, last, s, _ = _placed(part)
            if len(s):
                a, b = (_long_hash(words, LEAST, salt)[s].view(np.int64) for salt in (2, 3))
                cells = [a, b, place[s].astype(np.int32), first[s].astype(np.int32), last[s + LEAST - 1].astype(np.int32)]
                own = pa.array(rows[s])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(own), part.column("t").take(own), *map(pa.array, cells)], names=["doc_id", "t", "a", "b", "place", "start", "end"])


def _met(docs: DataFrame, places: DataFrame) -> DataFrame:
    """docs with the list column of `places`, which goes to the scan where it is small."""
    held = places.select(F.sum(F.size("places") * 4 + 24)).first()[0] or 0
    return docs.join(F.broadcast(places) if held <= BROADCAST_BYTES else places, ["doc_id", "t"])


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per passage to remove: doc_id, start, end (code points), n_words, first_doc_id, first_start.

    A passage is a longest stretch of words of a document every LEAST of which occurred before, in a document of
    smaller doc_id or earlier in the same one; first_doc_id is a document where its first LEAST words stand, first_start
    the offset there. Texts of fewer than LEAST words, null ones too, have none. Rows that repeat a doc_id with other
    texts are documents of their own, in the order of a digest of their texts; rows equal in both are one document: what
    only they share is not repeated. Rows with a null doc_id take no part. An empty table gives an empty table.
    """
    lean(docs.sparkSession)
    named = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), "text")
    # Copies of a whole text are found by its md5; one of each group, the smallest doc_id, stands for all.
    texts = staged(named.where("text is not null").select("doc_id", "t", F.md5(F.col("text").cast("binary")).alias("digest")), "suffixes-texts")
    ones = texts.groupBy("digest").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    copies = staged(texts.join(staged(ones, "suffixes-ones"), "digest").where("doc_id <> first_doc_id").select("first_doc_id", "doc_id", "t").distinct(), "suffixes-copies")
    few = copies.count() * 24 <= BROADCAST_BYTES
    one = F.broadcast(copies) if few else copies
    words, space = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), r"[\x20\x09-\x0D]+"
    head = F.length(F.regexp_replace("text", f"^{space}", ""))
    edge = F.length("text") - head
    copied = named.join(one, ["doc_id", "t"]).select("doc_id", "t", edge.cast("long").alias("start"), F.length(F.regexp_replace("text", f"{space}\\z", "")).cast("long").alias("end"), words.cast("long").alias("n_words"), "first_doc_id", edge.cast("long").alias("first_start"))
    copied = copied.where(F.col("n_words") >= LEAST).distinct().drop("t")
    named = named.join(one, ["doc_id", "t"], "left_anti")

    suffixes = staged(named.mapInArrow(_suffixes, "codes binary, key long, doc_id long, t long, place int"), "suffixes")
    ordered = suffixes.repartitionByRange("codes", "key", "doc_id", "t", "place").sortWithinPartitions("codes", "key", "doc_id", "t", "place")
    alive = ordered.mapInArrow(_neighbours, "key long, doc_id long, t long, place int").groupBy("doc_id", "t").agg(F.collect_set("place").alias("places"))
    alive = staged(alive, "suffixes-alive")
    groups = staged(_met(named, alive).mapInArrow(_groups, "doc_id long, t long, key long, a long, b long, back int, width int, place int, start int, end int"), "suffixes-groups")
    # Occurrences of a suffix with equal runs around it are one variant: all but the first are matches of the first.
    # Where a suffix has several variants, the runs of their first occurrences are compared one by one.
    earliest = F.min(F.struct("doc_id", "t", "place", "start")).alias("first")
    told = [F.col(f"first.{c}").alias(f"first_{c}") for c in ("doc_id", "t", "place", "start")]
    later = "doc_id <> first_doc_id or t <> first_t or place <> first_place"
    variants = groups.groupBy("key", "a", "b").agg(F.count("*").alias("n"), earliest)
    variants = staged(variants, "suffixes-variants")
    firsts = variants.where("n > 1").select("key", "a", "b", *told)
    whole = groups.join(staged(firsts, "suffixes-firsts"), ["key", "a", "b"]).where(later)
    whole = whole.select("doc_id", "t", (F.col("place") - F.col("back")).alias("place"), (F.col("width") + LEAST).alias("n"), "start", "end", "first_doc_id", "first_start")

    several = staged(variants.groupBy("key").agg(F.count("*").alias("v")).where("v > 1").select("key"), "suffixes-several")
    reps = variants.join(several, "key").select(F.col("first.doc_id").alias("doc_id"), F.col("first.t").alias("t"), F.col("first.place").alias("place"))
    open_ = staged(reps.groupBy("doc_id", "t").agg(F.collect_set("place").alias("places")), "suffixes-open")
    runs = staged(_met(named, open_).mapInArrow(_runs, "doc_id long, t long, a long, b long, place int, start int, end int"), "suffixes-runs")
    first = runs.groupBy("a", "b").agg(earliest, F.count("*").alias("n")).where("n > 1").select("a", "b", *told)
    first = staged(first, "suffixes-first")  # a join of two plain exchanges is one whose hot runs Spark can split
    again = runs.join(first, ["a", "b"]).where(later).select("doc_id", "t", "place", F.lit(LEAST).alias("n"), "start", "end", "first_doc_id", "first_start")
    row = F.struct("place", "n", "start", "end", "first_doc_id", "first_start")
    found = whole.union(again).groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(row)).alias("runs"))
    return copied.union(found.mapInArrow(_join, "doc_id long, start long, end long, n_words long, first_doc_id long, first_start long"))


def _join(batches):
    """Runs that follow each other or overlap are one passage."""
    for batch in (whole.slice(i, 200) for whole in batches for i in range(0, whole.num_rows, 200)):
        out = []
        for doc, runs in zip(batch.column("doc_id").to_pylist(), batch.column("runs").to_pylist()):
            held = None
            for r in runs:
                if held and r["place"] <= held[5]:
                    held[2], held[5] = max(held[2], r["end"]), max(held[5], r["place"] + r["n"])
                    continue
                if held:
                    out.append(held)
                held = [doc, r["start"], r["end"], r["first_doc_id"], r["first_start"], r["place"] + r["n"], r["place"]]
            if held:
                out.append(held)
        cells = ([x[0] for x in out], [x[1] for x in out], [x[2] for x in out], [x[5] - x[6] for x in out], [x[3] for x in out], [x[4] for x in out])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cells], names=["doc_id", "start", "end", "n_words", "first_doc_id", "first_start"])
