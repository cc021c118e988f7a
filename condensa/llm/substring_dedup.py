"""Repeated lines, paragraphs or segments: normalise, group digests over the whole corpus, keep the earliest, remove the rest.

A unit is a line, a paragraph (lines up to a blank one), or a segment (a line cut after .!?,;: that white space or the
line's end follows). It is compared by the md5 of its lower-cased words with single spaces. Occurrences rank by doc_id,
then by place in the document. Offsets are code points of the text as it is.

Which repeats are removed is one rule on runs: repeated units that follow each other in a document are one run, and a
run goes if it weighs LEAST_RUN or more. Short units are compared like all others and go with their run.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged

#: `repeated_units` leaves shorter units alone: a few words meet by chance.
LEAST_WORDS = 5
#: `repeated_runs` removes runs of this weight or more.
LEAST_RUN = 35
#: A unit weighs its words, or one for so many code points where that is more: text without spaces counts too.
WORD_CHARS = 8
#: White space of a unit, as its words are told apart.
SPACE = " \t\r\f\v"
_SPACES = re.compile(f"[{SPACE}]+")
_SEGMENT_END = re.compile(rf"[.!?,;:]+(?=[{SPACE}\n]|\Z)|\n")


def units(text: str, kind: str = "line"):
    """(start, end) of every unit: lines without their line ends, paragraphs, or segments without white space around them."""
    if kind == "segment":
        at = 0
        for end in [m.end() for m in _SEGMENT_END.finditer(text)] + [len(text)]:
            body = text[at:end].lstrip(SPACE + "\n")
            if body:
                start = end - len(body)
                yield start, start + len(body.rstrip(SPACE + "\n"))
            at = end
        return
    at, start, end = 0, None, 0
    for line in text.split("\n"):
        if kind == "line":
            yield at, at + len(line)
        elif line.strip(SPACE):
            start, end = at if start is None else start, at + len(line)
        elif start is not None:
            yield start, end
            start = None
        at += len(line) + 1
    if start is not None:
        yield start, end


_UNIT = "digest binary, row long, doc_id long, text_hash long, unit int, start int, end int, n_words int"


def _units(kind: str, least: int):
    def run(batches):
        for batch in batches:
            cols = [[] for _ in range(8)]
            for row, doc, hashed, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text_hash")), pc.fill_null(batch.column("text"), "").to_pylist()):
                for no, (a, b) in enumerate(units(text, kind)):
                    words = [w for w in _SPACES.split(text[a:b].lower().replace("\n", " ")) if w]
                    if len(words) >= least:
                        for col, x in zip(cols, (hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest(), row, doc, hashed, no, a, b, len(words))):
                            col.append(x)
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split(" ")[0] for f in _UNIT.split(", ")])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def _repeats(rows: DataFrame, kind: str, least_words: int) -> DataFrame:
    """Every occurrence of a unit but the earliest, with the row it stands in and first_doc_id, first_unit (the one that stays).

    `rows` has row, doc_id, text_hash, text. Rows rank by doc_id, then by their text's hash; rows equal in both are alike, so
    whichever of them comes first, the others are repeats.
    """
    lean(rows.sparkSession)
    found = staged(rows.mapInArrow(_units(kind, least_words), _UNIT), "units")
    first = found.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash", "row", "unit")).alias("first"), F.count("*").alias("n")).where("n > 1")
    # Written first: a join of two plain exchanges is one whose hot digests Spark can split.
    first = staged(first.select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.row").alias("first_row"), F.col("first.unit").alias("first_unit")), "units-first")
    same = (F.col("row") == F.col("first_row")) & (F.col("unit") == F.col("first_unit"))
    return found.join(first, "digest").where(~same).drop("digest", "first_row")


def repeated_units(docs: DataFrame, kind: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row per unit to remove: doc_id, unit, start, end, n_words, first_doc_id, first_unit (the one that stays), text_hash.

    Null and empty texts have no units. Rows that repeat a doc_id, or have none, are each a document of their own, equal
    rows too: all but one of them are repeats. Null ids rank first. An empty table gives an empty table.
    """
    return _repeats(_numbered(docs), kind, least_words).select("doc_id", "unit", "start", "end", "n_words", "first_doc_id", "first_unit", "text_hash")


def _runs(rows: DataFrame, kind: str, least_run: int) -> DataFrame:
    found = staged(_repeats(rows, kind, 1), "units-repeated")
    line = Window.partitionBy("row").orderBy("unit")
    weight = F.greatest(F.col("n_words"), F.floor((F.col("end") - F.col("start")) / WORD_CHARS)).cast("long")
    runs = found.withColumn("run", F.col("unit") - F.row_number().over(line)).withColumn("run_weight", F.sum(weight).over(Window.partitionBy("row", "run")))
    return runs.where(F.col("run_weight") >= least_run)


def repeated_runs(docs: DataFrame, kind: str = "segment", least_run: int = LEAST_RUN) -> DataFrame:
    """One row per unit to remove: doc_id, unit, start, end, n_words, run_weight, first_doc_id, first_unit (the one that stays),
    text_hash.

    All units are compared, however short; those go whose run of repeated units in their document weighs `least_run`
    or more; with `least_run` 1 every repeat comes, with its weight. A run is of one row's text, so it gathers no more than
    one document. Nulls, empty texts, repeated ids and rows, and empty tables as in `repeated_units`.
    """
    return _runs(_numbered(docs), kind, least_run).select("doc_id", "unit", "start", "end", "n_words", "run_weight", "first_doc_id", "first_unit", "text_hash")


def without_repeats(docs: DataFrame, kind: str = "segment", least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, text without its repeated runs, kept (the original offsets of what is left) of every row, each cut by itself.

    Of rows equal in id and text one stays whole. Nulls, empty texts and empty tables as in `removed`.
    """
    rows = staged(_numbered(docs), "units-rows")
    gone = _runs(rows, kind, least_run).groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    return rows.join(gone, "row", "left").select("doc_id", "text", "gone").mapInArrow(_cut, _LEFT)


def _cut(batches):
    for batch in batches:
        texts, kept = [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist()):
            spans, at = [], 0
            for g in sorted(gone or [], key=lambda g: g["start"]):
                end = g["end"] + 1 if g["end"] < len(text) else g["end"]  # with its line end
                if g["start"] > at:
                    spans.append({"start": at, "end": g["start"]})
                at = max(at, end)
            if text is not None and at < len(text):
                spans.append({"start": at, "end": len(text)})
            texts.append(None if text is None else "".join(text[s["start"] : s["end"]] for s in spans))
            kept.append(spans)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(kept, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "text", "kept"]
        )


_LEFT = "doc_id long, text string, kept array<struct<start: long, end: long>>"


def removed(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, text without the spans (doc_id, start, end, and text_hash where they have it) and their line ends, kept: the
    original offsets of what is left.

    A null text stays null. Spans go from the rows of their doc_id and text (null ids match null); spans without text_hash
    go from every row of their doc_id; rows equal in both lose the same spans (`without_repeats` tells them apart).
    Documents without spans keep all; empty tables give empty tables.
    """
    hashed = ["text_hash"] if "text_hash" in spans.columns else []
    gone = spans.groupBy("doc_id", *hashed).agg(F.collect_list(F.struct("start", "end")).alias("gone")).withColumnRenamed("doc_id", "of")
    rows = docs.select(F.col("doc_id").cast("long"), "text", *(F.xxhash64("text").alias("_hash") for _ in hashed))
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    rows = rows.join(gone, same & (F.col("_hash") == F.col("text_hash")) if hashed else same, "left")
    return rows.select("doc_id", "text", "gone").mapInArrow(_cut, _LEFT)
