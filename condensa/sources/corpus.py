"""Evaluation fixtures as rows: payloads written out, facts checked, budgets joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import base64_canonical

# ---- Fixed values ----------------------------------------------------------------------------------------------
FIXTURE_BYTES = 256 << 10
#: What may not stand beside the user's name.
NAME_CHARS = "[A-Za-z0-9_-]"
ADDRESS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
# ----------------------------------------------------------------------------------------------------------------

#: ADDRESS, tried only where a run of its first characters begins (or goes on behind the address before), each run once.
_ADDRESS = rf"(?:\G|(?<![A-Za-z0-9._%+-])){ADDRESS.replace(']+@', ']++@', 1)}"
PAYLOAD = "struct<kind: string, text: string, base64: string, fill: string, length: long>"


def materialised(payload: Column) -> Column:
    """Bytes of a payload: utf8 text, canonical base64, or text padded with a fill up to a length; null if malformed."""
    text = payload["text"].cast("binary")
    fill, missing = payload["fill"], payload["length"] - F.octet_length(payload["text"])
    padded = F.concat(text, F.substring(F.repeat(fill, (F.ceil(missing / F.greatest(F.octet_length(fill), F.lit(1)))).cast("int")).cast("binary"), F.lit(1), missing.cast("int")))
    return (
        F.when(payload["kind"] == "utf8", text)
        .when(payload["kind"] == "base64", base64_canonical(payload["base64"]))
        .when((payload["kind"] == "padded") & (missing >= 0) & (F.octet_length(fill) > 0), padded)
    )


def joined_events(events: Column) -> Column:
    """A process's bytes: its events' payloads in order."""
    ordered = F.array_sort(events, lambda a, b: (a["order"] - b["order"]).cast("int"))
    return F.aggregate(ordered, F.lit(b""), lambda a, e: F.concat(a, materialised(e["payload"])))


def invalid(fixtures: DataFrame) -> DataFrame:
    """(id, problem): facts that the source doesn't hold, fact ids that repeat, budgets that don't exist.

    `fixtures` has id, source (string), facts array<struct<id, class, needle>>, budget; known budgets are a column `budgets`.
    """
    c = F.col
    absent = F.exists("facts", lambda f: ~c("source").contains(f["needle"]))
    ids = F.transform("facts", lambda f: f["id"])
    problem = (
        F.when(F.exists("facts", lambda f: ~f["class"].isin("P0", "P1")), "unknown_class").when(F.size(ids) != F.size(F.array_distinct(ids)), "repeated_fact")
        .when(absent, "absent_fact").when(~F.array_contains("budgets", c("budget")), "unknown_budget")
    )
    return fixtures.select("id", problem.alias("problem")).where("problem is not null")


def manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON Lines manifest: path, line_no (from 1, blank lines count), the fields of `schema`, and malformed.

    Files are read in splits; a split's lines are numbered where they are read, and the lines of the splits before it
    are added by a join with one row a split.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("path", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = lines.join(F.broadcast(splits.select("path", "block", (ahead + 1 - F.col("first")).alias("shift"))), ["path", "block"]).withColumn("line_no", F.col("at") + F.col("shift"))
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = numbered.where(F.trim("value") != "").select("path", "line_no", parsed.alias("r"), F.json_object_keys("value").isNull().alias("no_object"))
    return out.select("path", "line_no", "r.*", "no_object").withColumn("malformed", F.col("no_object") | F.col("_bad").isNotNull()).drop("_bad", "no_object")


def with_budget(fixtures: DataFrame, budgets: DataFrame) -> DataFrame:
    """Fixtures with their budget's columns and error_code: invalid_request where no budget has that id. Budgets are a small table."""
    known = budgets.withColumnRenamed("id", "budget").withColumn("_known", F.lit(True))
    return fixtures.join(F.broadcast(known), "budget", "left").withColumn("error_code", F.when(F.col("_known").isNull(), "invalid_request")).drop("_known")


def with_fixture(questions: DataFrame, fixtures: DataFrame) -> DataFrame:
    """Questions (id, fixture, focus, answer) with their fixture's source, and whether the answer stands in it."""
    named = fixtures.select(F.col("id").alias("fixture"), "source")
    return questions.join(named, "fixture").withColumn("answerable", F.col("source").contains(F.col("answer")))


def normalised(text: Column, places: dict[str, str], author: tuple[str, str] | None = None, user: tuple[str, str] | None = None, address: str = "dev@example.invalid") -> Column:
    """Text without who and where it was captured: places (longest first) as literals, then addresses, the author's name, and the user as a word of its own."""
    for known in sorted((p for p in places if p), key=len, reverse=True):
        text = F.replace(text, F.lit(known), F.lit(places[known]))
    text = F.when(text.contains("@"), F.regexp_replace(text, _ADDRESS, address)).otherwise(text)
    if author and author[0]:
        text = F.replace(text, F.lit(author[0]), F.lit(author[1]))
    if user and user[0]:
        literal = "".join(c if c.isalnum() or c == "_" else f"\\{c}" for c in user[0])
        text = F.regexp_replace(text, f"{literal}(?<!{NAME_CHARS}{literal})(?!{NAME_CHARS})", user[1])  # the literal first: it is what is searched
    return text


def bounded(source: Column, limit: int = FIXTURE_BYTES) -> Column:
    """(bytes, truncated, source_bytes): at most `limit` bytes, cut after the last line end; where there is none, one byte before the last whole character begins."""
    window = F.decode(F.substring(source, 1, limit), "ISO-8859-1")  # a character a byte
    back = F.locate("\n", F.reverse(window))
    line = F.when(back > 0, F.length(window) - back + 1).otherwise(0)
    tail = F.length(F.regexp_extract(window, "[\x80-\xbf]*\\z", 0))
    end = F.when(line > 1, line).otherwise(F.greatest(F.length(window) - tail - 1, F.lit(0)))
    over = F.octet_length(source) > limit
    return F.struct(F.when(over, F.substr(source, F.lit(1), end)).otherwise(source).alias("bytes"), over.alias("truncated"), F.octet_length(source).cast("long").alias("source_bytes"))
