"""Hand-computed vectors and brute-force checks of plots, lines and measures."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from echoplane.operators import embed, lines, measures, recurrence, series, windows
from echoplane.sources import series as sources


def plot_of(spark, matrix):
    m = np.array(matrix)
    n = len(m)
    pairs = spark.createDataFrame([("a", i, j) for i in range(n) for j in range(i) if m[i, j]], "sid string, i int, j int")
    e = spark.createDataFrame([("a", t, [0.0]) for t in range(n)], "sid string, t int, e array<double>")
    return pairs, e


def hist_of(df):
    return {r.len: r.cnt for r in df.collect()}


def brute_runs(v):
    out, n = [], 0
    for x in [*v, 0]:
        if x:
            n += 1
        elif n:
            out.append(n)
            n = 0
    return out


def brute_measures(m, lmin=2):
    n = len(m)
    diag = [x for k in range(1, n) for x in brute_runs(np.diagonal(m, -k))] * 2
    vert = [x for j in range(n) for x in brute_runs(m[:, j])]
    out = {"recurrence_rate": m.sum() / n**2}
    for kind, name, runs in (("diagonal", "determinism", diag), ("vertical", "laminarity", vert)):
        long_ = [x for x in runs if x >= lmin]
        out[name] = sum(long_) / (sum(runs) + 1e-12)
        out[f"average_{kind}_length"] = sum(long_) / (len(long_) + 1e-12)
        p = np.array([long_.count(x) for x in set(long_)]) / max(1, len(long_))
        out[f"{kind}_entropy"] = float(-(p * np.log(p)).sum())
        out[f"max_{kind}_length"] = max(runs, default=1)
        out[f"{kind}_mode"] = min(set(long_), key=lambda x: (-long_.count(x), x)) if long_ else lmin
    return out


def test_hand_vectors(spark):
    # Columns 1,1,0 / 0,1,0 / 1,1,1: runs 2, 1, 3; zeros 3, so bin 0 is 3 - 3 + 3.
    vert = spark.createDataFrame([("a", i, j) for i, row in enumerate([[1, 0, 1], [1, 1, 1], [0, 0, 1]]) for j, v in enumerate(row) if v], "sid string, i int, j int")
    size = spark.createDataFrame([("a", 3)], "sid string, n int")
    assert hist_of(lines.full_histogram(lines.vertical_runs(vert), size, "vert")) == {0: 3, 1: 1, 2: 1, 3: 1}
    pairs, _ = plot_of(spark, np.ones((3, 3)))
    diag = lines.diagonal_runs(pairs)
    assert hist_of(lines.full_histogram(diag, size, "diag")) == {1: 2, 2: 2}
    assert hist_of(lines.full_histogram(diag, size, "diag", "legacy")) == {1: 2, 2: 2, 3: 1}


@pytest.mark.parametrize("hist,lmin,want", [([0, 10, 5], 1, {"share": 1.0}), ([0, 5, 7, 2, 0], 1, {"mode": 2}), ([0, 10, 5, 0], 1, {"mean": 20 / 15}), ([0, 10, 10], 1, {"entropy": math.log(2)})])
def test_histogram_vectors(spark, hist, lmin, want):
    df = spark.createDataFrame([("a", "vert", k, c) for k, c in enumerate(hist) if c], "sid string, kind string, len int, cnt long")
    made = measures.line_aggregates("vert", lmin)
    row = df.groupBy("sid").agg(*(c.alias(n) for n, c in made.items())).first()
    for k, v in want.items():
        assert row[k] == pytest.approx(v, abs=1e-9)


def test_checkerboard_rate(spark):
    pairs, e = plot_of(spark, [[(i + j + 1) % 2 for j in range(4)] for i in range(4)])
    assert recurrence.recurrence_rate(pairs, recurrence.sizes(e)).first().recurrence_rate == 0.5


def test_measures_and_windows_against_brute_force(spark):
    rng = np.random.default_rng(0)
    signals = [np.sin(np.linspace(0, 9, 50)) + 0.2 * rng.normal(size=50), rng.normal(size=37), np.ones(30), np.arange(12.0)]
    table = series.zscore(sources.from_arrays(spark, signals))
    got = {r.sid: r.asDict() for r in measures.rqa_measures(table, 2, 2, 0.6).collect()}
    wins = windows.windowed_measures(table, 10, 4, 2, 2, 0.6).collect()
    n_windows = 0
    for k, s in enumerate(signals):
        z = (s - s.mean()) / (s.std() + 1e-10)
        e = np.stack([z[:-2], z[2:]], axis=1)
        plot = (np.sqrt(((e[:, None] - e) ** 2).sum(axis=2)) < 0.6).astype(int)
        for name, v in brute_measures(plot).items():
            assert got[f"signal_{k}"][name] == pytest.approx(v, abs=1e-9), (k, name)
        for start in range(0, len(plot) - 9, 4):
            own = [w for w in wins if w.sid == f"signal_{k}" and w.window_start == start]
            assert len(own) == 1
            n_windows += 1
            for name, v in brute_measures(plot[start : start + 10, start : start + 10]).items():
                assert own[0][name] == pytest.approx(v, abs=1e-9), (k, start, name)
    assert n_windows == len(wins)


def test_three_ways_to_the_same_pairs(spark):
    rng = np.random.default_rng(1)
    e = embed.delay_embed(sources.from_arrays(spark, [rng.normal(size=70), rng.normal(size=5)]), 1, 2)
    plain = set(map(tuple, recurrence.recurrence_pairs(e, 0.7, 2).collect()))
    assert plain and plain == set(map(tuple, recurrence.recurrence_pairs(e, 0.7, 2, tile=8).collect()))
    assert plain == set(map(tuple, recurrence.recurrence_pairs_by_cell(e, 0.7, 2).collect()))
    radius = e.select("sid").distinct().withColumn("eps", F.lit(0.7))
    assert plain == set(map(tuple, recurrence.recurrence_pairs(e, radius).collect()))


def test_embedding_of_a_ramp(spark):
    ramp = sources.from_arrays(spark, [np.arange(50.0)])
    rows = embed.delay_embed(ramp, 2, 3).orderBy("t").collect()
    assert len(rows) == 46 and rows[0].e == [0.0, 2.0, 4.0]
    params = spark.createDataFrame([("signal_0", 2, 3)], "sid string, tau int, m int")
    assert sorted(map(tuple, embed.delay_embed_by(ramp, params).collect())) == sorted(map(tuple, rows))
    assert embed.delay_embed(sources.from_arrays(spark, [np.arange(3.0)]), 2, 3).count() == 0
    with pytest.raises(ValueError):
        embed.delay_embed(ramp, 0, 1)


def test_window_errors():
    for bad in ((0, 1), (5, 0)):
        with pytest.raises(ValueError):
            windows.check(*bad)
