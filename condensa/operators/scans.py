"""Scans along documents without a shuffle: running sums, groups and ranges over offset arrays, a batch at a time.

Rows come as `lines.lines` makes them: a document's lines one after the other in one partition, numbered from 0. Spark's
batches may cut a document, so its rows are held until it is whole; more than one document's lines are never held for long.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame


#: Tables of fewer bytes a core have fewer splits than cores.
SPREAD_BYTES = 16 << 20


def spread(rows: DataFrame) -> DataFrame:
    """rows as they are, or dealt to all cores where the table is so small that its splits would leave most of them idle.

    For work that costs far more than moving the rows; what is moved is bounded by SPREAD_BYTES a core. Rows stay the same.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if 0 < size < cores * SPREAD_BYTES else rows


#: Bytes and rows of a batch that Python works on at a time; what it makes of a row is several times the row.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 256


def pieces(batch: pa.RecordBatch, text: int):
    """A batch as slices of about PIECE_BYTES of the column number `text` and of PIECE_ROWS rows at most; a row is never cut."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    ends, begin = np.cumsum(sizes, dtype=np.int64), 0
    while begin < len(sizes):
        before = int(ends[begin - 1]) if begin else 0
        end = min(max(int(np.searchsorted(ends, before + PIECE_BYTES, "right")), begin + 1), begin + PIECE_ROWS)
        yield batch.slice(begin, end - begin)
        begin = end


def whole_documents(batches, at: str = "line_no"):
    """The same rows in batches that end where a document ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        firsts = np.flatnonzero(batch.column(at).to_numpy(zero_copy_only=False) == 0)
        cut = int(firsts[-1]) if len(firsts) else 0
        if cut or (held and len(firsts)):
            yield _joined([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.concat_batches(batches)


class Segments:
    """Documents (or other stretches) of a batch: where each begins, and scans that start anew there."""

    def __init__(self, begins: np.ndarray):
        self.first = np.flatnonzero(begins)
        self.sizes = np.diff(np.append(self.first, len(begins)))
        self.place = np.arange(len(begins)) - np.repeat(self.first, self.sizes)

    def running(self, values: np.ndarray) -> np.ndarray:
        """Sum from the segment's begin up to each row."""
        sums = np.cumsum(values, dtype=np.int64)
        return sums - np.repeat(sums[self.first] - values[self.first], self.sizes)

    def total(self, values: np.ndarray) -> np.ndarray:
        """The segment's sum at each of its rows."""
        return np.repeat(np.add.reduceat(values.astype(np.int64), self.first), self.sizes) if len(values) else values.astype(np.int64)


def scanned(spans: DataFrame, flags: dict, work: Callable, added: str) -> DataFrame:
    """spans without their text, with what `work(segments, *flags)` gives: columns of `added`. A row's flags are worked out by Spark."""
    kept = [c for c in spans.columns if c != "line"]
    names, asked = [f.split(" ")[0] for f in added.split(", ")], list(flags)

    def run(batches):
        for batch in whole_documents(batches):
            numbers = batch.column("line_no").to_numpy(zero_copy_only=False)
            told = work(Segments(numbers == 0), *(batch.column(f).to_numpy(zero_copy_only=False).astype(bool) for f in asked))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *map(pa.array, told)], names=[*kept, *names])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.schema if f.name in kept)
    return spans.select(*kept, *(c.alias(n) for n, c in flags.items())).mapInArrow(run, f"{schema}, {added}")


def regions(docs: DataFrame, pattern: str, before: int, after: int, most: int, key: str, text: str) -> DataFrame:
    """(key, start, end) of whole lines around the first `most` matches of a literal in each text; regions that meet are one.

    Matches are searched in the bytes of a whole batch, so the literal may hold line ends; both ends of a match are found
    among the batch's line starts by binary search.
    """
    what = pattern.encode()

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            _, ends, data = texts.buffers()
            kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
            edges = np.frombuffer(ends, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
            body = data.to_pybytes()[edges[0] : edges[-1]] if data is not None else b""
            rows, found = [], []
            if what in body:
                edges = edges - edges[0]
                starts = np.union1d(np.flatnonzero(np.frombuffer(body, np.uint8) == 10) + 1, edges)
                rows, found = _around(body, edges, starts, what, before, after, most)
            spans = np.array(found, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(spans[:, 0]), pa.array(spans[:, 1])], names=[key, "start", "end"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.where(f"`{text}` is not null").select(key, text).mapInArrow(run, f"`{key}` {kind}, start long, end long")


def _around(body: bytes, edges: np.ndarray, starts: np.ndarray, what: bytes, before: int, after: int, most: int) -> tuple[list, list]:
    """Rows and regions; `starts` are the line starts of all texts and the end of the last, `edges` the texts' begins and ends."""
    rows, out, at, row, left = [], [], 0, -1, 0
    while (at := body.find(what, at)) >= 0:
        end, here = at + len(what), int(np.searchsorted(edges, at, "right")) - 1
        low, high = int(edges[here]), int(edges[here + 1])
        if here != row:
            row, left = here, most
        if end > high:  # across two texts
            at += 1
            continue
        if not left:
            at = high
            continue
        left -= 1
        a = max(low, int(starts[max(int(np.searchsorted(starts, at, "right")) - 1 - before, 0)])) - low
        b = min(high, int(starts[min(int(np.searchsorted(starts, end, "left")) + after, len(starts) - 1)])) - low
        if rows and rows[-1] == here and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            rows.append(here)
            out.append((a, b))
        at = end
    return rows, out
