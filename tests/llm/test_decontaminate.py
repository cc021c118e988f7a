import random
import re

import pytest
from llm.helpers import DOCS, docs

from condensa.llm import decontaminate as D

ITEMS = "item_id long, text string"


def tokens(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def share(part, doc):
    k = min(5, len(part))
    wanted = {tuple(part[i : i + k]) for i in range(len(part) - k + 1)}
    have = {tuple(doc[i : i + k]) for i in range(len(doc) - k + 1)}
    return len(wanted & have) / len(wanted)


def brute(rows, items):
    out = set()
    for d, t, *_ in rows:
        doc = tokens(t)
        for i, text in items:
            if not tokens(text):
                continue
            q, a = D.split_answer(text)
            if share(tokens(text), doc) >= 0.8 or (share(tokens(q), doc) >= 0.8 and (not tokens(a) or share(tokens(a), doc) >= 0.5)):
                out.add((d, i))
    return out


def prose(rng, n, vocabulary=4000):
    common = ["the", "of", "and", "to", "in", "is"]
    return [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.mark.parametrize("block", [20_000, 7])
def test_hits_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(D, "INDEX_ITEMS", block)
    rng = random.Random(9)
    items = [(i, " ".join(prose(rng, rng.randint(6, 60))) + ".\n" * (i % 2) + " ".join(prose(rng, 9)) + ".") for i in range(30)]
    items += [(50, None), (51, ""), (52, "two words"), (53, "!!")]
    rows = []
    for d in range(200):
        body = prose(rng, rng.choice([0, 4, 30, 300, 5000]))
        for i in rng.sample(range(30), rng.choice([0, 0, 1, 2])):
            leak = items[i][1].split()
            if rng.random() < 0.4:
                leak[rng.randrange(len(leak))] = "changed"
            leak = [w.upper() for w in leak] if rng.random() < 0.3 else leak
            body = leak + body if rng.random() < 0.5 else body + prose(rng, 20) + leak  # an item stays in one piece
        rows.append((d, " ".join(body)))
    rows += [(900, None), (901, ""), (902, "here are two words!"), (903, "…")]
    got = D.contaminated(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(rows, items) and len(got) > 60
    clean = D.decontaminated(docs(spark, rows), spark.createDataFrame(items, ITEMS))
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {r.doc_id for r in got}


def test_the_size_of_an_index_changes_no_row(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(prose(rng, rng.randint(6, 40), 60)) + ".") for i in range(24)] + [(24, " ".join(prose(rng, 200, 60)))]
    rows = [(d, " ".join(prose(rng, 80, 60) + items[d % 25][1].split()[: rng.randint(4, 200)] + prose(rng, 80, 60))) for d in range(100)]
    found = []
    for size in (20_000, 5, 1):
        monkeypatch.setattr(D, "INDEX_ITEMS", size)
        got = D.contaminated(docs(spark, rows), spark.createDataFrame(items, ITEMS)).collect()
        found.append(sorted((r.doc_id, r.item_id, *(round(x, 9) for x in tuple(r)[2:])) for r in got))
    assert found[0] and found[1] == found[0] and found[2] == found[0]


def test_empty_sides(spark):
    some, none = docs(spark, [(1, "a b c d e f g")]), spark.createDataFrame([], DOCS)
    items = spark.createDataFrame([(1, "a b c d e f g")], ITEMS)
    assert D.contaminated(none, items).count() == 0
    assert D.contaminated(some, spark.createDataFrame([], ITEMS)).count() == 0
    assert [tuple(r)[:2] for r in D.contaminated(some, items).collect()] == [(1, 1)]


def test_another_layout_brings_its_own_split(spark):
    question, answer = " ".join(f"q{i}" for i in range(30)), " ".join(f"a{i}" for i in range(12))
    bench = spark.createDataFrame([(1, f"A: {answer} Q: {question}")], "item_id long, text string")
    rows = docs(spark, [(1, f"x y {question} z"), (2, f"{question} then {answer} end"), (3, "nothing at all")])
    turned = lambda t: tuple(reversed(t.removeprefix("A: ").split(" Q: ")))
    assert [r.doc_id for r in D.contaminated(rows, bench, turned).collect()] == [2]
    assert sorted(r.doc_id for r in D.decontaminated(rows, bench, lambda t: (turned(t)[0], "")).collect()) == [3]
