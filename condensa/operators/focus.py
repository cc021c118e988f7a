"""A focus: which of its terms locate something in a document, and how lines score by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.predicates import ascii_lower
from ..functions.text import focus_terms
from .kernel import focus_terms as terms_of


def masks(spans: DataFrame, focus: str) -> DataFrame:
    """Adds mask: one bit per focus term that the line holds."""
    terms = focus_terms(F.lit(focus))
    low = ascii_lower(F.col("line"))
    bits = F.transform(terms, lambda t, i: F.when(low.contains(t), F.expr("1")).otherwise(0))
    mask = F.aggregate(F.transform(bits, lambda b, i: b * F.pow(F.lit(2), i).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return spans.withColumn("mask", mask)


def term_hits(docs: DataFrame, focus: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, term, hits, lines): in how many lines of a document each term stands. No shuffle: a document's lines are one array."""
    holds = lambda t: lambda x: x.contains(F.lit(t))
    told = F.array(*(F.struct(F.lit(t).alias("term"), F.size(F.filter("low", holds(t))).cast("long").alias("hits")) for t in terms_of(focus)))
    each = _lowered(docs, key, text).select(key, F.size("low").cast("long").alias("lines"), F.explode(told).alias("t"))
    return each.select(key, "t.term", "t.hits", "lines")


def ranked(spans: DataFrame, focus: str, key: str = "doc_id") -> DataFrame:
    """Adds telling (mask of the terms in some but at most a quarter of the lines) and score (how many of them a line holds).

    The rule on any table of lines, by windows; for texts as they are `scored` gives the same without a shuffle.
    """
    out, whole = masks(spans, focus), Window.partitionBy(key)
    lines = F.count("*").over(whole)
    bits = []
    for i in range(16):
        hits = F.sum(F.getbit("mask", F.lit(i)).cast("long")).over(whole)
        bits.append(F.when((hits > 0) & (hits * 4 <= lines), 1 << i).otherwise(0).cast("long"))
    telling = bits[0]
    for b in bits[1:]:
        telling = telling + b
    return out.withColumn("telling", telling).withColumn("score", F.bit_count(F.col("mask").bitwiseAND(F.col("telling"))).cast("long"))


def _lowered(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, low): each document's lines in lower case; the explode of one item keeps the array from being worked out again."""
    low = F.transform(F.regexp_extract_all(F.translate(text, P.UPPER, P.LOWER), F.lit(P.LINE), F.lit(0)), lambda x: x)
    return docs.where(F.octet_length(text) > 0).select(key, F.explode(F.array(low)).alias("low"))


def _telling(terms: list[str]) -> Column:
    lines, out = F.size("low"), F.lit(0).cast("long")
    holds = lambda t: lambda x: x.contains(F.lit(t))
    for i, t in enumerate(terms):
        hits = F.size(F.filter("low", holds(t)))
        out += F.when((hits > 0) & (hits * 4 <= lines), 1 << i).otherwise(0)
    return out


def telling(docs: DataFrame, focus: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, telling) of every document with lines: the terms in some but at most a quarter of its lines, a bit each."""
    return _lowered(docs, key, text).select(key, _telling(terms_of(focus)).alias("telling"))


def scored(docs: DataFrame, focus: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, mask, telling, score) of every line of documents, as `ranked` gives them, without a shuffle.

    What tells is worked out on the document's own array of lines before it is exploded.
    """
    terms = terms_of(focus)
    rows = _lowered(docs, key, text).select(key, _telling(terms).alias("telling"), "low")
    each = rows.select(key, "telling", F.posexplode("low").alias("line_no", "line"))
    mask = F.lit(0).cast("long")
    for i, t in enumerate(terms):
        mask += F.when(F.col("line").contains(F.lit(t)), 1 << i).otherwise(0)
    each = each.select(key, "line_no", mask.alias("mask"), "telling")
    return each.withColumn("score", F.bit_count(F.col("mask").bitwiseAND(F.col("telling"))).cast("long"))
