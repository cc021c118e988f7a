"""As-of lookups: one window a session and slices of time give what a plain loop gives."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from condensa.streaming import intent

SCHEMA = "id long, session string, at long, prompt string"


def brute(rows, ttl):
    out = {}
    for i, session, at, _ in rows:
        said = [(t, p.strip()) for _, s, t, p in rows if s == session and session is not None and at is not None and t is not None and at - ttl <= t <= at and p and p.strip()]
        out[i] = max(said)[1] if said else None
    return out


def made(seed):
    rng = random.Random(seed)
    sessions = ["hot"] * 4 + [f"s{k}" for k in range(8)]
    rows = [(i, rng.choice(sessions), rng.randrange(0, 5000), rng.choice([None, None, None, " ", f"p{rng.randrange(9)}", f"  q{i} "])) for i in range(500)]
    return rows + [(900, None, 5, "x"), (901, None, 6, None), (902, "hot", None, "y"), (903, "hot", None, None), (904, "hot", 100, "a"), (905, "hot", 100, "b"), (906, "hot", 100, None)]


@pytest.mark.parametrize("ttl, seconds", [(400, 100), (400, 7), (50, 1000), (400, 400), (0, 10), (10_000, 60)])
def test_slices_equal_a_loop(spark, ttl, seconds):
    rows = made(ttl + seconds)
    got = intent.as_of_sliced(spark.createDataFrame(rows, SCHEMA), "session", "at", F.col("prompt"), ttl, seconds).collect()
    assert {r.id: r.intent for r in got} == brute(rows, ttl) and len(got) == len(rows)


def test_no_rows_and_other_columns(spark):
    none = intent.as_of_sliced(spark.createDataFrame([], SCHEMA), "session", "at", F.col("prompt"))
    assert none.columns == ["id", "session", "at", "prompt", "intent"] and none.count() == 0
    one = spark.createDataFrame([(1, "s", 5, "x")], SCHEMA).withColumn("ts", F.lit(9)).withColumn("digest", F.lit(1))
    assert intent.as_of_sliced(one, "session", "at", F.col("prompt")).first().intent == "x"


def test_records_are_named_by_digest(spark):
    rows = spark.createDataFrame([(1, "../../etc", 5, "first"), (2, "../../etc", 9, "last"), (3, None, 9, "x"), (4, "old", 1, "y"), (5, "s", 9, " ")], SCHEMA)
    got = intent.records(rows, "session", "at", F.col("prompt"), 100, 95).collect()
    assert [(r.digest, r.intent, r.ts) for r in got] == [(hashlib.sha256(b"../../etc").hexdigest(), "last", 9)]
