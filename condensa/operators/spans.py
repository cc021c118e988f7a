"""Algebra of byte spans as tables (key, start, end): merge, complement, partition check, translation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans that overlap or touch become one."""
    before = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(key).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(0))
    return spans.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(upto)).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def complement(spans: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """What disjoint spans leave of documents (key, size), those without spans included."""
    every = spans.select(key, "start", "end").union(sizes.select(key, F.col("size").alias("start"), F.col("size").alias("end")))
    order = Window.partitionBy(key).orderBy("start", "end")
    gaps = every.select(key, F.coalesce(F.lag("end").over(order), F.lit(0)).alias("from"), F.col("start").alias("to")).where(F.col("from") < F.col("to"))
    return gaps.select(key, F.col("from").alias("start"), F.col("to").alias("end"))


def is_partition(spans: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, gapless): whether the spans cover 0 .. size once each."""
    order = Window.partitionBy(key).orderBy("start", "end")
    joined = spans.withColumn("ok", F.col("start") == F.coalesce(F.lag("end").over(order), F.lit(0)))
    seen = joined.groupBy(key).agg(F.bool_and("ok").alias("ok"), F.max("end").alias("reach"))
    return sizes.join(seen, key, "left").select(key, (F.coalesce("ok", F.lit(True)) & (F.coalesce("reach", F.lit(0)) == F.col("size"))).alias("gapless"))


def translate(regions: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans of the regions' concatenation as spans of the source; a range join inside each document."""
    order = Window.partitionBy(key).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    laid = regions.select(key, F.col("start").alias("from"), F.coalesce(F.sum(F.col("end") - F.col("start")).over(order), F.lit(0)).alias("at"), (F.col("end") - F.col("start")).alias("size"))
    met = spans.join(laid, key).where("start < at + size and at < end")
    low, high = F.greatest("start", "at"), F.least("end", F.col("at") + F.col("size"))
    return merge(met.select(key, (F.col("from") + low - F.col("at")).alias("start"), (F.col("from") + high - F.col("at")).alias("end")), key)
