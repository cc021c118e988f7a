import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from llm.helpers import DOCS, docs

from condensa.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(rows, goals, n=1, percent=10, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in grams(x, n)[1]), Counter(bucket(f) for x in goals for f in grams(x, n)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (S + buckets) / ((s[b] + 1.0) * (T + buckets))))
    out = []
    for doc, text in rows:
        words, found = grams(text, n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(found), weight, score, None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = place
    return [tuple(r[:5]) for r in out]


def made():
    rng = random.Random(12)
    words = [f"w{i}" for i in range(300)] + ["Été", "ÀB", "İx", "straße", "日本", "A1b2", "🙂"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 19, 20, 25, 60])))) for i in range(400)]
    return rows + [(900, None), (901, ""), (902, "--- !!! \n"), (903, "ab" * 90_000 + " x" * 50), (904, "w1 " * 30_000), (905, "_w1_,W2;É" * 40)]


GOALS = ["w1 w2 w3 w4 w5 W6", "Été w7", None, ""]


@pytest.mark.parametrize("n", [1, 2])
def test_equals_brute_force(spark, n):
    rows = made()
    goals = spark.createDataFrame([(i, g) for i, g in enumerate(GOALS)], "item_id long, text string")
    got = importance.resample(docs(spark, rows), goals, grams=n).collect()
    key = lambda r: tuple(-1 if v is None else v for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows, [g or "" for g in GOALS], n), key=key)


def test_repeated_rows_and_null_ids_fill_the_ranks(spark):
    text = "w1 w2 " * 20
    rows = [(None, text)] * 300 + [(7, text)] * 200 + [(i + 100, text + f" w{i}") for i in range(200)] + [(None, text + " w9")] * 50
    got = importance.resample(docs(spark, rows), spark.createDataFrame([("w1",)], "text string"), percent=40).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 301)) and len(got) == 750
    ranked = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert all((-a.score, a.doc_id is None, a.doc_id or 0) <= (-b.score, b.doc_id is None, b.doc_id or 0) for a, b in zip(ranked, ranked[1:]))
    assert min(r.score for r in ranked) >= max(r.score for r in got if not r["rank"])


def test_of_nothing(spark):
    none, goals = spark.createDataFrame([], DOCS), spark.createDataFrame([("w1",)], "text string")
    assert importance.resample(none, goals).count() == 0
    few = importance.resample(docs(spark, [(1, "w1"), (2, None)]), spark.createDataFrame([], "text string")).collect()
    assert len(few) == 2 and all(r["rank"] is None for r in few)


def test_scoring_neither_shuffles_nor_explodes(spark):
    plan = importance.scored(docs(spark, made()), [0] * 10_000)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan and "Python" not in plan
