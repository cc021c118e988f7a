import math

import numpy as np
import pytest

from condensa.llm import embedding_dedup as E

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, least=0.95):
    ok = {}
    for i, (vid, v, _) in enumerate(rows):
        a = None if v is None else np.array([np.nan if x is None else x for x in v], np.float32).astype(float)
        if vid is not None and a is not None and len(a) and np.isfinite(a).all() and a.any():
            ok[i] = a / np.linalg.norm(a)
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = dict.fromkeys(range(len(rows)), 0)
    keys = list(ok)
    for x, i in enumerate(keys):
        for j in keys[:x]:
            if len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(rows[i][0]), find(rows[j][0])
                root[max(a, b)] = min(a, b)
    return sorted((str(rows[i][0]), links[i], str(None if rows[i][0] is None else find(rows[i][0]))) for i in links)


def clouds(seed, n, dim=24):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 4)):
            noise = rng.normal(size=dim) * rng.choice([0, 0.05, 0.2, 0.3, 0.5])
            rows.append((int(rng.integers(0, 10**9)), ((base + noise) * rng.uniform(0.1, 9)).tolist(), 1))
    return rows


@pytest.mark.parametrize("block,tile", [(2048, 512), (16, 8)])
def test_links_equal_brute_force(spark, monkeypatch, block, tile):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "TILE", tile)
    rows = clouds(3, 120) + clouds(4, 20, 7) + [(-5, [1.0] * 24, 0)] * 3 + [(k, [2.0] * 24, 0) for k in range(40)]
    rows += [(1011, None, 1), (1012, [], 1), (1013, [0.0] * 24, 1), (1014, [1.0, None] * 12, 1), (1015, [1.0, math.inf] * 12, 1), (1016, [math.nan] * 24, 1), (None, [1.0] * 24, 1), (1017, [1e38] * 24, 1), (1018, [1e-38] * 24, 1), (1019, [-0.0] * 24, 1)]
    got = E.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_no_vectors(spark):
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert E.near_duplicates(spark.createDataFrame([(1, None, 1)], SCHEMA)).collect()[0].kept


def test_pairs_at_the_threshold_pass_the_count():
    rng = np.random.default_rng(1)
    a = E.unit(rng.normal(size=(4000, 64)))
    side = rng.normal(size=a.shape)
    side = E.unit(side - (side * a).sum(1, keepdims=True) * a)
    b = 0.95 * a + math.sqrt(1 - 0.95**2) * side
    gap = np.abs((a - b) @ E.directions(64))
    hits = (gap <= E.WINDOW * math.sqrt(0.1)).sum(1)
    assert (hits >= E.least_count()).mean() > 0.998
    assert E.least_count() >= 16
    other = np.abs((a - a[::-1]) @ E.directions(64)) <= E.WINDOW * math.sqrt(0.1)
    assert (other.sum(1) >= E.least_count()).mean() < 0.01


def test_one_tight_group_of_near_vectors_is_dealt_out(spark, monkeypatch):
    """Vectors that differ by a millionth share one slot of the projection; blocks stay bounded and every link is counted."""
    monkeypatch.setattr(E, "BLOCK", 32)
    rng = np.random.default_rng(3)
    base, n = rng.normal(size=16), 300
    rows = [(i, (base + rng.normal(size=16) * 1e-6).tolist()) for i in range(n)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(60)]
    got = {r.vec_id: r for r in E.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i].n_links == n - 1 and got[i].component_id == 0 for i in range(n)) and sum(r.kept for r in got.values()) >= 50
