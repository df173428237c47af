"""Queries of the older forms of searches, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import information, parameters, recurrence
from ..sources import series as sources
from . import oracles as o
from .oracles import build, r
from .registry import embedded, flat, query, z

# Only states with a sample one delay later take part; of several nearest, state 0 takes the last one.
_NB = {
    **{k: v for k, v in o.FNN.items() if k.startswith("d") or k in ("sg", "rg")},
    "nb": " UNION ALL ".join(
        f"""SELECT {m} AS m, sid, i, j, dm + 1e-9 AS dm, dn, n FROM (SELECT a.sid, a.i, a.j, a.d AS dm, b.d AS dn, n FROM d{m} a JOIN d{m + 1} b ON a.sid = b.sid AND a.i = b.i AND a.j = b.j AND b.d IS NOT NULL JOIN nz ON nz.sid = a.sid)
        QUALIFY row_number() OVER (PARTITION BY sid, i ORDER BY dm, CASE WHEN i = 0 AND j = n - {m} - 1 THEN -1 ELSE j END) = 1"""
        for m in range(1, 9)
    ),
    "fc": "SELECT m, sid, k, r, sum(CASE WHEN dm < sd / r AND dn / dm > r THEN 1 ELSE 0 END) / (sum(CASE WHEN dm < sd / r THEN 1 ELSE 0 END) + 1e-9) AS fnn FROM nb JOIN sg USING (sid) CROSS JOIN rg GROUP BY m, sid, k, r",
    "r0": "SELECT g.m, nz.sid, coalesce(min(CASE WHEN fnn < 0.001 THEN r END), -1.0) AS r0 FROM nz CROSS JOIN range(1, 9) g(m) LEFT JOIN fc ON fc.sid = nz.sid AND fc.m = g.m GROUP BY g.m, nz.sid",
}
_RATIO = {k: v for k, v in _NB.items() if k not in ("rg", "fc", "r0")}


@query("nearest_neighbour_legacy", build(f"SELECT sid, i AS t, j AS nn, {r('dm - 1e-9', 'd')} FROM nb WHERE m = 2", "pz", "nz", **_RATIO))
def _(spark, d):
    return recurrence.nearest_neighbours_legacy(embedded(spark, d), 1, 2)


@query("fnn_ratio_legacy", build(f"SELECT sid, {r('sum(CASE WHEN dm < sd / 2 AND dn / dm > 2 THEN 1 ELSE 0 END) / (sum(CASE WHEN dm < sd / 2 THEN 1 ELSE 0 END) + 1e-9)', 'fnn')} FROM nb JOIN sg USING (sid) WHERE m = 2 GROUP BY sid", "pz", "nz", **_RATIO))
def _(spark, d):
    return parameters.fnn_ratio(z(spark, d), 1, 2, 2.0, legacy=True)


@query("fnn_r0_legacy", build(f"SELECT sid, m, {r('r0', 'r0')} FROM r0 WHERE m <= 3", "pz", "nz", **_NB))
def _(spark, d):
    return parameters.fnn_zero_upto(z(spark, d), 1, 3, legacy=True)


@query("embedding_dim_legacy", build("SELECT sid, coalesce(max(CASE WHEN r0 - nx > 0.2 THEN m + 1 END), -1)::BIGINT AS m FROM (SELECT *, lead(r0) OVER (PARTITION BY sid ORDER BY m) AS nx FROM r0) GROUP BY sid", "pz", "nz", **_NB))
def _(spark, d):
    return parameters.embedding_dimension_legacy(z(spark, d), 1)


@query("eps_search_legacy", build(f"SELECT s.sid, {r('coalesce(min(k) * (10.0::DOUBLE / 1000), -1.0)', 'eps')} FROM sz_rp s LEFT JOIN cv ON cv.sid = s.sid AND abs(rate - 0.001) < 0.0005 GROUP BY s.sid", "sz_rp", "emb2", pd=o.EPS["pd"], cv=o.EPS["cv"]))
def _(spark, d):
    from ..config import RqaConfig

    # So small a rate that many series have no radius for it.
    return parameters.radius_legacy(embedded(spark, d), RqaConfig(reqrr=0.001, rr_delta=0.0005), 2)


_MI = {
    **{k: v for k, v in o.MI.items() if k not in ("lm", "lb", "ta")},
    "lm": "SELECT sid, n, n - 1 AS tmax FROM nz",
    "lb": "SELECT sid, tau, n, B, CASE WHEN x1 > x0 THEN least(B - 1, floor((x - x0) / (x1 - x0) * B)) ELSE B // 2 END AS bx, CASE WHEN y1 > y0 THEN least(B - 1, floor((y - y0) / (y1 - y0) * B)) ELSE B // 2 END AS by_ FROM (SELECT *, 15 AS B FROM (SELECT *, count(*) OVER w AS n, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM lg WINDOW w AS (PARTITION BY sid, tau)))",
}
_MI = {k: _MI[k].replace("1e-12", "1e-9") for k in ("lm", "lg", "lb", "hx", "hy", "hxy", "mi")}


@query("mi_curve_legacy", build(f"SELECT sid, tau, {r('mi', 'mi')} FROM mi", "z", "nz", **_MI))
def _(spark, d):
    s = z(spark, d)
    lags = s.groupBy("sid").agg((F.count(F.lit(1)) - 1).cast("int").alias("tau_max"))
    return information.mi_curve(s, lags=lags, bins=15, pseudo=1e-9)


@query("tau_first_min_legacy", build("SELECT lm.sid, coalesce(min(CASE WHEN mi > p THEN tau - 1 END), max(tmax) - 1)::BIGINT AS tau FROM lm JOIN (SELECT *, lag(mi) OVER (PARTITION BY sid ORDER BY tau) AS p FROM mi) USING (sid) GROUP BY lm.sid", "z", "nz", **_MI))
def _(spark, d):
    return information.delay_legacy(z(spark, d))


@query("first_minimum_legacy", build("SELECT sid, coalesce(min(CASE WHEN (p IS NULL OR v < p) AND v < q THEN t END), arg_min(t, v))::BIGINT AS first_min FROM (SELECT sid, t, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ev WINDOW w AS (PARTITION BY sid ORDER BY t)) GROUP BY sid", "ev"))
def _(spark, d):
    return information.first_minimum(flat(sources.ev_user(spark, d), "v"), "t", "v", legacy=True)
