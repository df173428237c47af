"""Invariants of surrogates, filters, systems, models and scores."""

import math

import numpy as np
import pytest

from echoplane.functions import kernels as k
from echoplane.functions import special
from echoplane.ml import benchmarks, models
from echoplane.operators import generate, stats
from echoplane.sources import series as sources


def test_surrogates_keep_what_they_should():
    rng = np.random.default_rng(42)
    x = np.cumsum(rng.normal(size=128))
    c = x - x.mean()
    for kind, make in k.SURROGATES.items():
        y = make(x, np.random.default_rng(1))
        assert len(y) == len(x) and np.isfinite(y).all(), kind
    assert np.allclose(np.abs(np.fft.rfft(k.ft(x, rng)))[1:-1], np.abs(np.fft.rfft(c))[1:-1])
    for make in (k.aaft, k.iaaft, k.idfs):
        assert np.allclose(np.sort(make(x, rng)), np.sort(c))
    y = k.iaaft(x, rng, end="spectrum")
    assert np.allclose(np.abs(np.fft.rfft(y))[1:-1], np.abs(np.fft.rfft(c))[1:-1], rtol=1e-6)
    for make in (k.permuted, k.shifted, k.cycle_shuffled):
        assert np.allclose(np.sort(make(x, rng)), np.sort(x))


def test_wavelets_invert():
    x = np.random.default_rng(0).normal(size=128)
    levels = k.wavelet_levels(x)
    assert len(levels) > 2 and np.allclose(k.wavelet_inverse(levels), x)
    assert sum((v**2).sum() for v in levels) == pytest.approx((x**2).sum())


def test_high_pass():
    b, a = k.butter_high(4, 0.1)
    w = np.exp(-1j * np.pi * np.array([0.0, 0.1, 0.9]))
    gain = np.abs(np.polyval(b[::-1], w) / np.polyval(a[::-1], w))
    assert gain[0] < 1e-9 and gain[1] == pytest.approx(math.sqrt(0.5), abs=1e-6) and gain[2] == pytest.approx(1, abs=1e-3)
    t = np.arange(400)
    slow, fast = np.sin(t / 60), np.sin(t * 1.5)
    y = k.filter_both_ways(b, a, slow + fast)
    assert np.abs(y - fast)[50:-50].max() < 0.05
    white = np.random.default_rng(1).normal(size=2000)
    assert not k.pink_filter(white)[2] and k.pink_filter(np.cumsum(white))[2]


def test_pchip_is_monotone_and_exact():
    t, v = np.array([0.0, 1, 2, 4, 5]), np.array([0.0, 1, 1, 3, 10])
    assert np.allclose(k.pchip(t, v, t), v)
    assert (np.diff(k.pchip(t, v, np.linspace(0, 5, 200))) >= -1e-12).all()


def test_flows():
    x = k.flow("lorenz", 50, 100, 0.01, {p: np.array([v, v]) for p, v in k.FLOWS["lorenz"][1].items()}, np.ones((2, 3)))
    fine = k.integrate(lambda s: k.FLOWS["lorenz"][0](s, {p: np.array([v]) for p, v in k.FLOWS["lorenz"][1].items()}), np.ones((1, 3)), np.linspace(0, 1, 100), 0.0005)[::2][:50]
    assert x.shape == (50, 2, 3) and np.allclose(x[:, 0], fine[:, 0], atol=2e-5)
    with pytest.raises(ValueError):
        k.flow("lorenz", 50, 10, 0.01, {}, np.ones((1, 3)))


def test_seeded_operators(spark):
    table = sources.from_arrays(spark, [np.sin(np.linspace(0, 9, 64)), np.arange(64.0)])
    one, two = (sorted((r.sid, r.rep, r.t, r.x[0]) for r in generate.surrogates(table, "FT", 3).collect()) for _ in range(2))
    assert one == two and len(one) == 2 * 3 * 64
    with pytest.raises(KeyError):
        generate.surrogates(table, "nothing")
    with pytest.raises(ValueError):
        generate.simulate(spark.range(1).withColumnRenamed("id", "sid"), "nothing")
    assert generate.critical_coupling(1) == pytest.approx(math.sqrt(8 / math.pi))
    low = [r.value for r in generate.regime_values(spark, "uniform", 50, "below", 4.2, low=3.0, high=6.0).collect()]
    assert len(low) == 50 and max(low) < 4.2
    wide = generate.window_sensitivity(table, "determinism", [20, 40], 50, tau=1, m=2, eps=0.5)
    again = generate.window_sensitivity(table, "determinism", [20, 40], 50, tau=1, m=2, eps=0.5)
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, again.collect()))
    with pytest.raises(ValueError, match="Unknown measure"):
        generate.window_sensitivity(table, "nothing", [20])


def test_special():
    assert special.chi2_sf(16.919, 9) == pytest.approx(0.05, abs=1e-4) and special.chi2_sf(0, 3) == 1
    assert special.wilcoxon_p(np.array([1.0, 2, 3, 4, 5])) == (0.0, pytest.approx(2 / 32))
    assert special.wilcoxon_p(np.zeros(4)) == (0.0, 1.0)


def _blobs(n=20, k_=2, seed=42):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(size=(n, 4)) + 3 * c for c in range(k_)])
    return x, np.repeat(np.arange(k_), n)


@pytest.mark.parametrize("name", sorted(models.MODELS))
def test_models_learn(name):
    for classes in (2, 3):
        x, y = _blobs(20, classes)
        extra = {"n_trees": 20} if name in ("rf", "et") else {"n_rounds": 10} if name == "gb" else {}
        p = models.make(name, **extra).fit(x, y, np.random.default_rng(0)).predict_proba(x)
        assert p.shape == (len(x), classes) and np.allclose(p.sum(axis=1), 1, atol=1e-6)
        assert models.scores(y, p)["accuracy"] > 0.9


def test_unknown_model():
    with pytest.raises(ValueError, match="Unknown model"):
        models.make("nothing")


def test_clusters():
    x, y = _blobs(15, 3)
    for method in models.CLUSTERS.values():
        label, _ = method(x, 3, np.random.default_rng(0))
        assert models.adjusted_rand(np.asarray(label), y) > 0.9
    i = models.cluster_indices(x, y)
    assert i["silhouette"] > 0.4 and i["davies_bouldin"] < 1


def test_groups_stay_together():
    y, g = np.tile([0, 1], 20), np.repeat(np.arange(10), 4)
    fold = models.stratified(y, 3, np.random.default_rng(0), g)
    assert all(len(set(fold[g == c])) == 1 for c in range(10)) and len(set(fold)) == 3


def _table(spark, x, y):
    return spark.createDataFrame([(i, str(c), v.tolist()) for i, (v, c) in enumerate(zip(x, y))], "id long, label string, features array<double>")


def test_benchmarks(spark):
    x, y = _blobs()
    df = _table(spark, x, y)
    cv = benchmarks.nested_cv(df, "nb", 4, inner_repeats=1).cache()
    assert cv.count() == 4 and cv.agg({"accuracy": "avg"}).first()[0] > 0.9
    freq = {r.feature: r.frequency for r in benchmarks.feature_frequency(cv, list("abcd")).collect()}
    assert freq and all(0 < v <= 1 for v in freq.values())
    quick = benchmarks.quick_benchmark(df, ("knn", "nb"), 3).collect()
    assert [r.model for r in quick] and quick[0].accuracy_mean >= quick[1].accuracy_mean > 0.8
    null = benchmarks.permutation_null(df, "nb", 6).agg({"accuracy": "avg"}).first()[0]
    assert 0.25 < null < 0.75
    both = cv.unionByName(benchmarks.nested_cv(df, "lda", 4, select=False))
    t = benchmarks.pairwise_tests(both).first()
    assert t.model_a == "lda" and 0 <= t.p_adjusted <= 1
    sweep = benchmarks.cluster_sweep(df, ("kmeans",), range(2, 4)).collect()
    assert [r.n_clusters for r in sorted(sweep, key=lambda r: r.n_clusters)] == [2, 3] and sweep[0].adjusted_rand is not None
    assert benchmarks.cluster_stability(df, "kmeans", 2, 6).first().mean_ari > 0.8
    for wrong, match in ((lambda: benchmarks.cluster_stability(df, "agglomerative"), "predict"), (lambda: benchmarks.cluster_sweep(df, ("x",)), "Unknown method"), (lambda: benchmarks.nested_cv(_table(spark, x, np.zeros(40, int))), "two classes")):
        with pytest.raises(ValueError, match=match):
            wrong()


def test_rank_p_and_corrections(spark):
    real = spark.createDataFrame([("a", 10.0), ("b", 0.0)], "k string, value double")
    null = spark.createDataFrame([(c, float(v)) for c in "ab" for v in range(1, 6)], "k string, value double")
    p = {r.k: r.p for r in stats.rank_p_value(real, null, ("k",)).collect()}
    assert p == {"a": pytest.approx(1 / 6), "b": 1.0}
    assert {r.k: r.p for r in stats.rank_p_value(real, null, ("k",), side="less").collect()}["b"] == pytest.approx(1 / 6)
    ps = lambda *v: spark.createDataFrame([(str(k_), x) for k_, x in enumerate(v)], "k string, p double")
    assert all(r.significant for r in stats.benjamini_hochberg(ps(0.01, 0.02, 0.03)).collect())
    got = {r.k: r.significant for r in stats.benjamini_hochberg(ps(0.01, 0.5, 0.9)).collect()}
    assert got == {"0": True, "1": False, "2": False}


def test_surrogates_of_many_series_at_once():
    from echoplane.functions.hashrng import HashRng

    x = np.round(np.random.default_rng(3).normal(size=(9, 67)), 2)
    for kind in k.TOGETHER:
        make = (k.SURROGATES | k.LEGACY_SURROGATES)[kind]
        got = k.alternate_all(kind, x, [HashRng(kind, i) for i in range(9)])
        assert np.allclose(got, [make(v, HashRng(kind, i)) for i, v in enumerate(x)], atol=1e-12), kind
