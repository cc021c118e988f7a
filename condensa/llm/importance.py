"""Importance resampling towards a target text: hashed n-grams, log ratios of bucket shares, a draw of the best with Gumbel noise.

Scores are worked out without exploding a document: higher-order functions make its array of buckets, and the sum of
gains is an aggregate over element_at of one literal array. Only counts of buckets and of scores are shuffled, and the
drawn rows, to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: What stands between words: all of ASCII but digits and letters. A-Z become a-z word by word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BUCKETS = 10_000
GRAMS = 1
SEED = "2024"
LEAST_WORDS = 20
PERCENT = 10


def words(text: Column) -> Column:
    """Words of a text as written; none for null."""
    return F.array_remove(F.coalesce(F.split(text, GAP, -1), F.array().cast("array<string>")), "")


def lowered(word: Column) -> Column:
    """The word with A-Z as a-z and all else as it is; `lower` alone does more to letters beyond ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def bucketed(table: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """table with _words, the number of words of `text`, and _buckets: the bucket of every run of 1 to `grams` consecutive
    words, joined by one space, repeats included: crc32 of its UTF-8 bytes modulo `buckets`. `text` is dropped."""
    bucket = lambda f: (F.crc32(f.cast("binary")) % buckets).cast("int")
    kept = [c for c in table.columns if c != "text"]
    if grams == 1:
        found = table.select(*kept, words(F.col("text")).alias("_found"))
        return found.select(*kept, F.size("_found").cast("long").alias("_words"), F.transform("_found", lambda w: bucket(lowered(w))).alias("_buckets"))
    found = table.select(*kept, F.transform(words(F.col("text")), lowered).alias("_found"))  # a column of its own: a lambda would work it out for each run

    def runs(k: int) -> Column:
        starts = F.when(F.size("_found") >= k, F.sequence(F.lit(1), F.size("_found") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(F.concat_ws(" ", *(F.get(F.col("_found"), i + (j - 1)) for j in range(k)))))  # a slice copies the whole array

    return found.select(*kept, F.size("_found").cast("long").alias("_words"), F.concat(F.transform("_found", bucket), *map(runs, range(2, grams + 1))).alias("_buckets"))


def bucket_counts(table: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many features of `table` (text) fall into each bucket. Tasks sum their own first, so at most `buckets` rows of each are shuffled."""
    seen = bucketed(table.select("text"), grams, buckets).select(F.explode_outer("_buckets").alias("bucket"))  # `explode` would bring a filter that makes each array twice
    return seen.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of every bucket, in doubles: `buckets` numbers on the driver."""
    count = lambda table, name: bucket_counts(table, grams, buckets).withColumnRenamed("n", name)
    known = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0)
    whole = lambda c: F.sum(c).over(Window.partitionBy()) + buckets  # noqa: E731  `buckets` rows
    ratio = (F.col("t") + 1).cast("double") * whole("s").cast("double") / ((F.col("s") + 1).cast("double") * whole("t").cast("double"))
    told = known.select("bucket", F.floor(F.lit(1000.0) * F.ln(ratio)).alias("gain")).collect()
    return [gain for _, gain in sorted(told)]


def scored(docs: DataFrame, gain: list[int], grams: int = GRAMS, seed: str = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and tie (a digest of the text) of every row; no shuffle."""
    literal = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")  # constant: folded into one literal array
    at = F.col("_buckets")
    whole = F.aggregate(at, F.lit(0).cast("long"), lambda total, b: total + F.element_at(literal, b + 1))
    n = F.size(at).cast("long")
    drawn = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((drawn + 0.5) / 4294967296.0)))
    mean = F.expr("(_sum - pmod(_sum, n_features)) div n_features")  # rounds down, in whole numbers
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return (
        bucketed(rows, grams, len(gain))
        .select("doc_id", "tie", F.col("_words").alias("n_words"), n.alias("n_features"), whole.alias("_sum"))
        .withColumn("weight", F.when(F.col("n_features") > 0, mean).otherwise(0).cast("long"))
        .select("doc_id", "tie", "n_words", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    )


def numbered(rows: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """`rows` (doc_id, score, tie, ...) with rank: 1, 2, ... for the floor(percent N / 100) highest scores of the N eligible
    rows, by score, then smaller doc_id (null last), then tie; null for the others.

    Scores are whole numbers, so they are counted first: the count says which scores can be drawn and how many rows
    stand before each. The rows of one score are split by ranges of their ids, and numbered inside their range.
    """
    counts = rows.where(eligible).groupBy("score").agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n")).first()[0] or 0
    quota = percent * totals // 100
    if not quota:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    order = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # one row per distinct score
    last = counts.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") - F.col("n") < quota).agg(F.min("score")).first()[0]
    drawable = eligible & (F.col("score") >= last)
    key = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("tie")]
    # Rows equal in all three are alike, so any order among them will do; the salt lets ranges cut through them.
    dealt = rows.where(drawable).withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*key, F.asc("salt"))
    dealt = staged(dealt.withColumn("part", F.spark_partition_id()), "importance-drawn")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    ahead = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*key, F.asc("salt")))
    ranked = dealt.join(F.broadcast(ahead), "part").withColumn("rank", (F.col("ahead") + inside).cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= quota, F.col("rank"))).select(*rows.columns, "rank")
    return rows.where(~F.coalesce(drawable, F.lit(False))).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, grams: int = GRAMS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text), drawn towards the texts of target (text).

    Null and empty texts have no features: weight 0, never drawn unless `least_words` is 0. A null doc_id is drawn as
    the word "null" and comes last among equal scores. Rows that repeat are scored and ranked each on its own; ties of
    score and doc_id are settled by the text. Texts are read whole. An empty target has all shares alike; an empty table
    of documents gives an empty table. Extra columns play no part.
    """
    rows = staged(scored(docs, gains(docs, target, grams, buckets), grams, seed), "importance-scores")
    return numbered(rows, F.col("n_words") >= least_words, percent).select("doc_id", "n_features", "weight", "score", "rank")
