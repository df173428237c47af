"""Information, delays, dimensions and radii against numpy."""

import numpy as np
import pytest

from echoplane.config import RqaConfig
from echoplane.operators import embed, information, nonlinear, parameters, series
from echoplane.sources import series as sources


def np_mi(x, y, bins=None, pseudo=1e-12):
    b = bins or min(15, max(3, int(np.cbrt(len(x)) + 1e-9)))
    p = np.histogram2d(x, y, b)[0] + pseudo
    px, py = np.histogram(x, b)[0] + pseudo, np.histogram(y, b)[0] + pseudo
    h = lambda q: ((q / q.sum()) * np.log2(q / q.sum())).sum()
    return h(p) - h(px) - h(py)


def test_mutual_information(spark):
    rng = np.random.default_rng(2)
    s = np.sin(np.linspace(0, 20, 120)) + 0.1 * rng.normal(size=120)
    curve = {r.tau: r.mi for r in information.mi_curve(sources.from_arrays(spark, [s])).collect()}
    assert set(curve) == set(range(1, 30))
    for tau, mi in curve.items():
        assert mi == pytest.approx(np_mi(s[:-tau], s[tau:]), abs=1e-6)
    want = next((t - 1 for t in range(2, 30) if curve[t] > curve[t - 1]), 29)
    assert information.delay(sources.from_arrays(spark, [s])).first().tau == want


def test_legacy_delay_of_a_sine(spark):
    s = np.sin(np.linspace(0, 4 * np.pi, 100))
    assert information.delay_legacy(sources.from_arrays(spark, [s])).first().tau == 7


def test_bin_rules(spark):
    t = sources.from_arrays(spark, [np.random.default_rng(0).normal(size=100)])
    got = {k: information.bin_counts(t, k).first().bins for k in ("sqrt", "rice", "sturges", "default")}
    assert got == {"sqrt": 10, "rice": 10, "sturges": 6, "default": 15}
    with pytest.raises(ValueError):
        information.bin_counts(t, "nothing")


@pytest.mark.parametrize("v,want", [([5], 0), ([1, 3, 4, 2], 0), ([3, 2, 4, 5], 1), ([5, 4, 4, 4, 5], 1), ([1, 2, 3, 4, 5], 0)])
def test_first_minimum(spark, v, want):
    df = spark.createDataFrame([("a", k, float(x)) for k, x in enumerate(v)], "sid string, t int, v double")
    assert information.first_minimum(df, "t", "v").first().first_min == want


def test_ksg_tells_dependence(spark):
    rng = np.random.default_rng(42)
    x, y = rng.random(200), rng.random(200)
    rows = [("same", t, [float(a)], [float(a)]) for t, a in enumerate(x)] + [("other", t, [float(a)], [float(b)]) for t, (a, b) in enumerate(zip(x, y))]
    got = {r.sid: r.mi for r in information.ksg(spark.createDataFrame(rows, "sid string, t int, x array<double>, y array<double>"), 5).collect()}
    assert got["same"] > 2 and abs(got["other"]) < 0.3


def np_r0(z, m, tau, cfg):
    n = len(z)
    if n <= (m + 1) * tau:
        return -1
    emb = lambda q: np.stack([z[k * tau : n - (q - 1) * tau + k * tau] for k in range(q)], axis=1)
    a, b = emb(m), emb(m + 1)
    d = np.sqrt(((a[:, None] - a) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    nn = d.argmin(axis=1)
    i = np.flatnonzero(nn[: len(b)] < len(b))
    dm, dn = d[i, nn[i]] + 1e-12, np.sqrt(((b[i] - b[nn[i]]) ** 2).sum(axis=1))
    sd = 3 * z.std()
    for r in np.linspace(cfg.rmin, cfg.rmax, cfg.rdiv):
        near = dm < sd / r
        if (near & (dn / dm > r)).sum() / (near.sum() + 1e-12) < cfg.delta:
            return r
    return -1


def test_dimension_and_radius(spark):
    rng, cfg = np.random.default_rng(5), RqaConfig()
    signals = [np.sin(np.linspace(0, 18, 60)), rng.normal(size=45), np.cumsum(rng.normal(size=50)), np.arange(9.0)]
    table = series.zscore(sources.from_arrays(spark, signals))
    zs = [(s - s.mean()) / (s.std() + 1e-10) for s in signals]
    for m in (1, 3):
        got = {r.sid: r.r0 for r in parameters.fnn_zero(table, 2, m).collect()}
        for k, z in enumerate(zs):
            assert got[f"signal_{k}"] == pytest.approx(np_r0(z, m, 2, cfg), abs=1e-6), (k, m)
    e = embed.delay_embed(table, 1, 2)
    got = {r.sid: r.eps for r in parameters.radius(e).collect()}
    for k, z in enumerate(zs):
        p = np.stack([z[:-1], z[1:]], axis=1)
        d = np.sqrt(((p[:, None] - p) ** 2).sum(axis=2))
        want = next((x for x in np.linspace(0, 10, 1001)[1:] if abs((d < x).mean() - 0.1) < 0.005), 5.0)
        assert got[f"signal_{k}"] == pytest.approx(want, abs=1e-9)


def test_group_radius_of_a_constant(spark):
    e = embed.delay_embed(sources.from_arrays(spark, [np.ones(50)]), 1, 1)
    cfg = RqaConfig(reqrr=0.99, rr_delta=0.011, epsmin=0.1, epsmax=1.0, epsdiv=10)
    assert parameters.group_radius_joint(e, cfg).first().eps == pytest.approx(0.1)


def test_nonlinear_edges(spark):
    table = sources.from_arrays(spark, [np.arange(8.0), np.ones(60)])
    rows = {r.sid: r for r in nonlinear.all_metrics(table).collect()}
    assert rows["signal_0"].lyapunov is None and rows["signal_0"].irreversibility is None and rows["signal_0"].dimension is None
    assert rows["signal_1"].lyapunov is None and rows["signal_1"].nonlinearity is None
