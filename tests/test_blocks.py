"""Points in blocks: copies, ties and points that miss their own vote, and blocks that do not travel too often."""

import math

import numpy as np
import pytest

from echoplane.operators import stats


def _points(spark, n=300):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(n, 8)), 1) + 100
    x[n // 2 : n // 2 + 40] = x[:40]
    x[-20:] = x[0]  # more copies than neighbours
    y = rng.integers(0, 3, n)
    return x, y, spark.createDataFrame([(i, int(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))], "id long, label int, features array<double>")


def test_neighbours_and_silhouette(spark):
    x, y, p = _points(spark)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    far = d.copy()
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, :5]
    want = {i: int(np.argmax(np.bincount(y[r], minlength=3))) for i, r in enumerate(near)}
    assert {r.id: r.yhat for r in stats.knn_predict(p, p, 5, leave_one_out=True).collect()} == want
    n = np.bincount(y)
    m = np.stack([d[:, y == c].sum(axis=1) / (n[c] - (y == c)) for c in range(3)], axis=1)
    own = m[np.arange(len(x)), y]
    m[np.arange(len(x)), y] = np.inf
    assert stats.silhouette(p).first().score == pytest.approx(np.mean((m.min(axis=1) - own) / np.maximum(own, m.min(axis=1))), abs=1e-9)


def test_copies_are_no_distance_apart():
    x = np.full((3, 64), 1e4) + np.arange(3)[:, None] * 1e-3
    got = np.concatenate([d for _, d in stats._distances(x, x)])
    assert np.allclose(got, np.abs(np.subtract.outer(range(3), range(3))) * 8e-3, rtol=1e-6, atol=0)


def test_rows_travel_in_proportion():
    # 615,000 points of 64 numbers, each sent once for every block of the others.
    assert math.ceil(615_000 / stats.BLOCK_POINTS) * 615_000 * 64 * 8 * 2 < 35e9


def test_long_work_in_small_rows_is_dealt(spark):
    from echoplane.ml import benchmarks
    from echoplane.operators import generate
    from echoplane.sources import series as sources

    x, y, p = _points(spark, 100)
    t = sources.from_arrays(spark, [np.sin(np.arange(30.0))])
    cv = benchmarks.nested_cv(p.selectExpr("id % 2 as g", "id", "label", "features"), "nb", 1, select=False, keys=("g",))
    for df in (cv, generate.surrogates(t, "FT", 3), generate.window_sensitivity(t, "determinism", [10], 5, tau=1, m=2, eps=0.5)):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
