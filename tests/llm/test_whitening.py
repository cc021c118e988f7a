import numpy as np
import pytest

from condensa.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute(rows, k=16):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([np.floor(64 * np.array(v, np.float32).astype(float)).astype(np.int64) + 1_000_000 for _, v in kept])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    white = (x - total / n) @ axes / np.sqrt(values)
    return [i for i, _ in kept], n, ((n * x - total) ** 2).sum(axis=1), white, values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("d", [3, 16, 24, 70])
def test_equals_dense_eigenvectors(spark, d):
    rng = np.random.default_rng(d)
    vectors = (rng.standard_normal((150, d)) * np.linspace(1, 3, d)).astype(np.float32)
    rows = list(enumerate(vectors.tolist()))
    rows += [(1000, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (1001, None), (1002, [None] * d), (1003, [float("nan")] * d), (1004, [float("inf")] + [0.0] * (d - 1)), (1005, []), (1006, [1.0] * (d + 1)), (1007, [0.0] * d)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    ids, n, deviation, white, explained = brute([r for r in rows if r[1] is None or len(r[1]) == d])
    k = min(16, d)
    assert len(got) == len(ids) * k and (got.n == n).all() and got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9
    got = got.assign(id=got.vec_id.fillna(-1)).sort_values(["id", "component", "whitened"])
    order = np.argsort([-1 if i is None else i for i in ids], kind="stable")
    for c in range(1, k + 1):
        part = got[got.component == c].sort_values(["id"], kind="stable")
        assert part.deviation.tolist() == deviation[order].tolist()
        want = white[order, c - 1]
        sign = np.sign((part.whitened.to_numpy() * want).sum())
        assert np.abs(part.whitened.to_numpy() * sign - want).max() < 1e-8
        assert np.abs(part.explained / explained[c - 1] - 1).max() < 1e-10


def test_fewer_components_than_dimensions(spark):
    rng = np.random.default_rng(5)
    flat = rng.standard_normal((60, 4)) @ rng.standard_normal((4, 30))
    rows = list(enumerate((np.round(flat * 64) / 64).tolist()))
    exact = [(i, [v[0], v[1], *[0.5] * 28]) for i, v in rows]
    got = whitening.whiten(frame(spark, exact)).toPandas()
    assert sorted(got.component.unique()) == [1, 2] and got.identity_error.iloc[0] < 1e-9
    assert abs(got.drop_duplicates("component").explained.sum() - 1) < 1e-9


def test_equal_vectors_and_nothing(spark):
    assert whitening.whiten(frame(spark, [(1, [1, 2]), (2, [1, 2])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0


def test_huge_entries(spark):
    rows = [(i, [i * 3e30, i - 5.0, (-1) ** i * 0.25]) for i in range(12)]
    got = whitening.whiten(frame(spark, rows)).toPandas()
    assert got.vec_id.nunique() == 12 and np.isfinite(got.whitened).all() and got.deviation.isna().all()


@pytest.mark.parametrize("spectrum", ["flat", "falling", "repeated", "low"])
def test_lanczos(spectrum):
    rng, d = np.random.default_rng(7), 260
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {"flat": np.linspace(1, 2, d), "falling": 1.0 / np.arange(1, d + 1), "repeated": np.r_[np.full(20, 3.0), np.ones(d - 20)], "low": np.r_[np.ones(5), np.zeros(d - 5)]}[spectrum]
    a = (q * values) @ q.T
    got, axes, passes = whitening.leading(lambda b: a @ b, d, limit=96)
    assert np.abs(got - np.sort(values)[::-1][:16]).max() < 1e-12 and np.abs(axes.T @ axes - np.eye(16)).max() < 1e-12
    assert np.linalg.norm(a @ axes - axes * got, axis=0).max() < 1e-11 and passes < 100
