"""The neighbour layout equals a dense eigen-solution and keeps neighbourhoods better than PCA."""

import numpy as np

from cantoria.operators import layout as ly
from cantoria.operators import learn as ml


def _roll(n=300, seed=2):
    """Points of a rolled-up sheet: near along the roll is not near in a plane's view."""
    rng = np.random.default_rng(seed)
    t = 1.5 * np.pi * (1 + 2 * np.sort(rng.random(n)))
    return np.c_[t * np.cos(t), 4 * rng.random(n), t * np.sin(t)]


def _graph(x, k):
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    a = np.zeros((len(x), len(x)))
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    a[np.arange(len(x))[:, None], near] = 1
    return np.maximum(a, a.T)


def _trust(x, y, k=10):
    """Trustworthiness: how far the neighbours in the layout are neighbours in truth."""
    n = len(x)
    dx, dy = (np.linalg.norm(z[:, None] - z[None], axis=2) for z in (x, y))
    np.fill_diagonal(dx, np.inf)
    np.fill_diagonal(dy, np.inf)
    rank = np.argsort(np.argsort(dx, axis=1), axis=1) + 1
    bad = sum(max(0, rank[i, j] - k) for i in range(n) for j in np.argsort(dy[i])[:k])
    return 1 - 2 * bad / (n * k * (2 * n - 3 * k - 1))


def test_layout_equals_dense_eigenvectors_and_keeps_neighbours(spark):
    x = _roll()
    df = spark.createDataFrame([(i, v.tolist(), "extra") for i, v in enumerate(x)], "id long, v array<double>, _u string")
    rows = ly.spectral_layout(df, "id", "v", k=2, neighbours=10).orderBy("id").collect()
    got = np.array([[r["c1"], r["c2"]] for r in rows])
    a = _graph(x, 10)
    deg = a.sum(axis=1)
    s = a / np.sqrt(np.outer(deg, deg))
    values, vectors = np.linalg.eigh(s)
    want = vectors[:, [-2, -3]] / np.sqrt(deg)[:, None] * np.sqrt(deg.sum())
    for j in range(2):
        u = got[:, j] * np.sqrt(deg / deg.sum())
        assert abs(u @ u - 1) < 1e-6 and np.linalg.norm(s @ u - values[-2 - j] * u) < 1e-4
        assert abs(values[-2 - j] - u @ s @ u) < 1e-8
        assert min(np.abs(got[:, j] - want[:, j]).max(), np.abs(got[:, j] + want[:, j]).max()) < 1e-2
        assert (got[:, j] ** 3).sum() >= 0
    flat = ml.project(df, "v", 2).orderBy("id").collect()
    assert _trust(x, got) > _trust(x, np.array([[r["c1"], r["c2"]] for r in flat]))


def test_parts_without_links_nulls_and_small_tables(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(30, 3)), rng.normal(size=(30, 3)) + 100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(None, [0.0, 0.0, 0.0]), (99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    out = {r["id"]: r["c1"] for r in ly.spectral_layout(df, "id", "v", k=1, neighbours=6).collect()}
    assert len(out) == 62 and out[99] is None and out[None] is None
    one, two = [out[i] for i in range(30)], [out[i] for i in range(30, 60)]
    assert np.ptp(one) < 1e-2 and np.ptp(two) < 1e-2 and abs(one[0] - two[0]) > 1
    assert [tuple(r) for r in ly.spectral_layout(df.where("id = 3"), "id", "v", k=2).select("c1", "c2").collect()] == [(None, None)]
    assert ly.spectral_layout(df.limit(0), "id", "v").count() == 0
    pair = ly.spectral_layout(df.where("id < 2"), "id", "v", k=3).orderBy("id").collect()
    assert abs(pair[0]["c1"] + pair[1]["c1"]) < 1e-6 and abs(pair[0]["c1"]) > 0.1 and pair[0]["c2"] == pair[0]["c3"] == 0
