"""Documents as tables of lines with exact byte offsets, and what is ordered along them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import Line
from . import scans

#: Lines that a text's sections may offer together: each offers its first lines, as many as are left to it.
MOST_SECTION_LINES = 256


def _cut(batches):
    """Lines and their offsets of whole texts, worked out on the bytes of a batch: lines tile them, so none is copied."""
    for batch in (piece for whole in batches for piece in scans.pieces(whole, 1)):
        texts = batch.column(1)
        _, ends, data = texts.buffers()
        n = len(texts)
        wide = pa.types.is_large_string(texts.type)
        offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        body = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if n and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        first = offsets - offsets[0]
        cuts = np.union1d(np.flatnonzero(body == 10) + 1, first[1:])
        cuts = cuts[cuts > 0]
        row = np.searchsorted(first, cuts - 1, "right") - 1
        start = np.r_[0, cuts[:-1]] if len(cuts) else cuts
        begin = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(cuts) else cuts
        number = np.arange(len(cuts)) - np.repeat(begin, np.diff(np.append(begin, len(cuts)))) if len(cuts) else cuts
        line = pa.Array.from_buffers(texts.type, len(cuts), [None, pa.py_buffer(np.r_[0, cuts].astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(body))])
        cells = [batch.column(0).take(pa.array(row)), pa.array(number.astype(np.int32)), line, pa.array(start - first[row]), pa.array(cuts - first[row])]
        yield pa.RecordBatch.from_arrays(cells, names=[batch.schema.names[0], "line_no", "line", "start", "end"])


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line, start, end): lines keep their line end, offsets are bytes; no text, no lines.

    No shuffle: offsets are worked out next to the scan, a batch of whole texts at a time.
    """
    kind = docs.schema[key].dataType.simpleString()
    return docs.where(F.col(text).isNotNull()).select(key, text).mapInArrow(_cut, f"`{key}` {kind}, line_no int, line string, start long, end long")


def first_last(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """The first and last line of every document: what a projection always offers."""
    ends = [F.min_by(c, "line_no").alias(f"first_{c}") for c in ("start", "end")] + [F.max_by(c, "line_no").alias(f"last_{c}") for c in ("start", "end")]
    return spans.groupBy(key).agg(*ends)


def section_ranks(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds opens, section (0 before the first), rank (0 on an opener, 1 on a line that precedes any) to rows as `lines` gives
    them, without their text and without a shuffle."""
    return scans.scanned(spans, {"_opens": Line(F.col("line")).opens_section}, lambda s, opens: _sections(s, opens), "opens boolean, section long, rank long")


def _sections(documents: scans.Segments, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    section = documents.running(opens.astype(np.int64))
    place = scans.Segments(opens | (documents.place == 0)).place
    return opens, section, place + (section == 0)


def admitted(spans: DataFrame, preferred: Column, matched: Column, distributes: bool = False, most: int = 256, key: str = "doc_id") -> DataFrame:
    """Candidate lines: the first `most` preferred ones (within their section's depth) and the first `most` that match.

    Rows as `lines` gives them; they come without their text, with by_kind and by_focus, and without a shuffle.
    """
    flags = {"_preferred": preferred, "_matched": matched} | ({"_opens": Line(F.col("line")).opens_section} if distributes else {})

    def work(documents: scans.Segments, by_kind, by_focus, *opens):
        if opens:
            _, _, rank = _sections(documents, opens[0])
            by_kind = by_kind & (rank <= np.maximum(MOST_SECTION_LINES // np.maximum(documents.total(opens[0]), 1), 1))
        first = lambda x: x & (documents.running(x.astype(np.int64)) <= most)
        return first(by_kind), first(by_focus)

    return scans.scanned(spans, {n: F.coalesce(c, F.lit(False)) for n, c in flags.items()}, work, "by_kind boolean, by_focus boolean").where("by_kind or by_focus")
