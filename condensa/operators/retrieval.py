"""Bounded retrieval as tables: regions of whole lines by number or by a literal pattern."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scans
from .spans import merge


def by_lines(spans: DataFrame, first: int, number: int, key: str = "doc_id") -> DataFrame:
    """(key, start, end) of lines first .. first + number - 1, counted from 1; nothing past the end."""
    held = spans.where((F.col("line_no") >= max(first - 1, 0)) & (F.col("line_no") < max(first - 1, 0) + number))
    return held.groupBy(key).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def by_text(docs: DataFrame, pattern: str, before: int = 2, after: int = 2, most: int = 8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, end) around the first `most` matches of any literal, also one across lines; regions that meet are one.

    Whole texts in Arrow batches, no shuffle. Rows that share a key are searched each on its own. A null or empty text
    has no regions; an empty literal is refused.
    """
    if not pattern:
        raise ValueError("a pattern is wanted")
    return scans.regions(docs, pattern, before, after, most, key, text)


def by_pattern(spans: DataFrame, pattern: str, before: int = 2, after: int = 2, most: int = 8, key: str = "doc_id") -> DataFrame:
    """(key, start, end) around the first `most` matches of a literal without line ends; regions that meet are one.

    A line's matches are counted without a regular expression; context is a range of line numbers, found by windows
    over the document rather than a join. Patterns with line ends want the texts: `by_text`.
    """
    if "\n" in pattern or not pattern:
        raise ValueError("a pattern of one line is wanted")
    order = Window.partitionBy(key).orderBy("line_no")
    hits = ((F.length("line") - F.length(F.replace("line", F.lit(pattern), F.lit("")))) / F.lit(len(pattern))).cast("long")
    seen = spans.withColumn("hits", hits).withColumn("earlier", F.sum("hits").over(order) - F.col("hits"))
    seen = seen.withColumn("hit", (F.col("hits") > 0) & (F.col("earlier") < most))
    near = Window.partitionBy(key).orderBy("line_no").rowsBetween(-after, before)
    held = seen.withColumn("held", F.max(F.col("hit").cast("int")).over(near) == 1).where("held")
    return merge(held.select(key, "start", "end"), key)
