"""Normalised values are decided to the last bit by the order of time, and so are bins and ties of theirs."""

import math

import numpy as np

from echoplane.operators import series as s


def _plain(v):
    total = mean = m2 = 0.0
    for n, q in enumerate(v, 1):
        total += q
        new = mean + (q - mean) / n
        m2, mean = m2 + (q - new) * (q - mean), new
    return [(q - total / len(v)) / (math.sqrt(m2 / len(v)) + 1e-10) for q in v]


def test_zscore_is_summed_in_time(spark):
    rng = np.random.default_rng(7)
    values = {k: np.round(rng.normal(50, 20, 70), 2).tolist() for k in range(60)}
    rows = [(k, t, [q]) for k, v in values.items() for t, q in enumerate(v)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    table = spark.createDataFrame(rows, "sid long, t int, x array<double>").repartition(7)
    got = {(r.sid, r.t): r.x[0] for r in s.zscore(table).collect()}
    assert all(got[k, t] == q for k, v in values.items() for t, q in enumerate(_plain(v)))
    gaps = spark.createDataFrame([(0, 0, [1.0]), (0, 1, [None]), (0, 2, [3.0])], "sid long, t int, x array<double>")
    assert [r.x[0] for r in s.zscore(gaps, guard=0.0).orderBy("t").collect()] == [-1.0, None, 1.0]


def test_angle_where_x_is_zero(spark):
    rows = [(0, 0, [0.0, 2.0]), (0, 1, [0.0, -2.0]), (0, 2, [1.0, 1.0]), (0, 3, [0.0, 0.0])]
    table = spark.createDataFrame(rows, "sid long, t int, x array<double>")
    got = [r.x[0] for r in s.polar(table, "angle").orderBy("t").collect()]
    assert got[:3] == [math.pi / 2, -math.pi / 2, math.pi / 4] and math.isnan(got[3])
