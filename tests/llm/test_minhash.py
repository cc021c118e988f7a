import random

import numpy as np
import pyarrow as pa
import pytest
from llm.helpers import DOCS, docs

from condensa.llm import minhash_dedup as M


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows, least=0.8):
    """doc_id -> smallest doc_id reachable over pairs with that Jaccard."""
    sets = {d: grams(t) for d, t, *_ in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: find(d) for d in ids}


def varied(rng, words, changes):
    w = list(words)
    for _ in range(changes):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=1, n=150):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        base = [f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.choice([3, 8, 60, 200, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append((len(rows) * 7 + 1, varied(rng, base, rng.choice([0, 0, 1, 3, len(base) // 40]))))
    rng.shuffle(rows)
    return rows


def test_classes_equal_brute_force(spark):
    rows = corpus() + [(5000, None), (5001, ""), (5002, " \n "), (5003, "one"), (5004, "ONE"), (5005, "same line here " * 400), (5006, "same line here " * 390)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)
    assert len({c for c in got.values()}) < len(rows) and got[5004] == 5003 and got[5001] == 5001


def test_near_copies_without_a_heavily_repeated_line(spark):
    rng, rows = random.Random(12), []
    for k in range(20):
        base, line = [f"d{k}w{rng.randrange(10**6)}" for _ in range(150)], [f"d{k}l{i}" for i in range(20)]
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(base + line * 200))]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows) and set(got.values()) == set(range(0, 40, 2))


def test_large_groups_need_no_all_pairs(spark):
    rng = random.Random(4)
    base, other = [f"b{i}" for i in range(300)], [f"c{i}" for i in range(300)]
    rows = [(i, varied(rng, base, rng.randint(0, 4))) for i in range(0, 600)] + [(i, " ".join(other)) for i in range(600, 1200)]
    # a chain: each is close to the next only, and its smallest id is in the middle
    chain = [" ".join(other[k * 12 : 200 + k * 12]) for k in range(5)]
    rows += [(2000 + i, t) for i, t in zip((3, 1, 0, 2, 4), chain)]
    found = M.near_duplicates(docs(spark, rows)).toPandas()
    assert dict(zip(found.doc_id, found.component_id)) == brute(rows)
    assert found.kept.sum() == found.component_id.nunique()


def test_rows_without_ids_repeated_rows_and_no_rows(spark):
    text = " ".join(f"x{i}" for i in range(40))
    rows = [(None, text), (None, text), (3, text), (3, text), (1, text), (8, None)]
    got = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in M.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(-1, None, True)] * 2 + [(3, 1, False)] * 2 + [(1, 1, True), (8, 8, True)], key=str)
    assert sorted(r.doc_id or -1 for r in M.deduplicated(docs(spark, rows)).collect()) == [-1, -1, 1, 8]
    assert M.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_registers_agree_with_the_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = rng.integers(1, 2**63, 400, dtype=np.uint64), rng.integers(1, 2**63, 100, dtype=np.uint64)
    both = np.r_[a, b]
    wa, wb = np.r_[rng.uniform(1, 4, 400), np.zeros(100)], np.r_[np.zeros(100), rng.uniform(1, 4, 400)]
    sign = [M.prob_minhash(both[w > 0], w[w > 0], np.zeros((w > 0).sum(), int), 1, 4096)[0] for w in (wa, wb)]
    shared = [i for i in range(500) if wa[i] and wb[i]]
    want = sum(1 / sum(max(wa[j] / wa[i], wb[j] / wb[i]) for j in range(500)) for i in shared)
    assert abs((sign[0] == sign[1]).mean() - want) < 4 * np.sqrt(want * (1 - want) / 4096)


def test_signatures_do_not_depend_on_the_batch():
    texts = [r[1] for r in corpus(3, 20)] + [None, ""]
    one = M.shingle_sets(pa.array(texts))
    m = 50
    whole = M.prob_minhash(one[0], 1 + np.log(one[2]), one[1], len(texts), m)
    for i, t in enumerate(texts):
        h, r, n = M.shingle_sets(pa.array([t], pa.string()))
        assert np.array_equal(whole[i], M.prob_minhash(h, 1 + np.log(n), r, 1, m)[0])
        assert len(h) == len(grams(t))


@pytest.mark.parametrize("block", [3, 20])
def test_groups_of_many_blocks_lose_no_link(spark, monkeypatch, block):
    """Members that miss their pivot are alike only to other members: chains, and a pivot on the edge of its group."""
    monkeypatch.setattr(M, "BLOCK_ROWS", block)
    rng = random.Random(block)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, varied(rng, base, rng.randint(0, 3))) for i in range(60)]
    long_ = [f"c{i}" for i in range(400)]
    rows += [(1000 + i, " ".join(long_[k * 5 : 150 + k * 5])) for i, k in enumerate(rng.sample(range(40), 40))]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows) and len({got[1000 + i] for i in range(40)}) == 1


def test_recall_of_pairs_near_the_threshold(spark):
    """400 pairs with a Jaccard of 0.8 to 0.9, the hardest: each is in two rows, so a class of two is a pair that was found."""
    rng, rows, near = random.Random(21), [], []
    while len(near) < 400:
        k = len(rows)
        base = [f"p{k}w{rng.randrange(10**6)}" for _ in range(rng.choice([60, 150, 300]))]
        other = varied(rng, base, rng.randint(1, 6))
        a, b = grams(" ".join(base)), grams(other)
        if 0.8 <= len(a & b) / len(a | b) < 0.9:
            near.append(k)
            rows += [(k, " ".join(base)), (k + 1, other)]
    got = {r.doc_id: r.component_id for r in M.near_duplicates(docs(spark, rows)).collect()}
    found = sum(got[k + 1] == k for k in near)
    assert found >= 399, found
