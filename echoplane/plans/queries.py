"""The relational queries, with their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..operators import embed, features, generate, information, lines, measures, nonlinear, parameters, plotdata, recurrence, series, stats, windows
from ..sources import series as sources
from . import oracles as o
from .oracles import build, r
from .registry import ORACLE, QUERIES, embedded as _e2, flat as _flat, points as _points, query, z as _z, z2 as _z2


def _rp(spark, d):
    e = _e2(spark, d)
    return recurrence.recurrence_pairs(e, 0.5, 2), e


# ------------------------------------------------------------------ samples


@query("zscore", build(f"SELECT sid, t, {r('v', 'v')} FROM z", "z"))
def _(spark, d):
    return _flat(_z(spark, d), "v")


@query("zscore_2d", build(f"SELECT sid, t, {r('x', 'x')}, {r('y', 'y')} FROM z2", "z2"))
def _(spark, d):
    return _flat(_z2(spark, d), "x", "y")


# A nudge of 1e-8 keeps means that end in a 5 from being rounded either way.
@query("detrend", build(f"SELECT sid, t, {r('v - avg(v) OVER (PARTITION BY sid) + 1e-8', 'v')} FROM ev", "ev"))
def _(spark, d):
    return _flat(series.detrend(sources.ev_user(spark, d)), "v").withColumn("v", F.col("v") + 1e-8)


@query("moving_average", build(f"SELECT sid, t, {r('m', 'v')} FROM (SELECT sid, t, avg(v) OVER w AS m, count(*) OVER w AS c FROM ev WINDOW w AS (PARTITION BY sid ORDER BY t ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE c = 5", "ev"))
def _(spark, d):
    return _flat(series.moving_average(sources.ev_user(spark, d), 5), "v")


@query("decimate", build(f"SELECT sid, t // 3 AS t, {r('v', 'v')} FROM ev WHERE t % 3 = 0", "ev"))
def _(spark, d):
    return _flat(series.decimate(sources.ev_user(spark, d), 3), "v")


@query("polar_transform", build(f"SELECT sid, t, {r('sqrt(x * x + y * y)', 'radius')}, {r('atan(y / x)', 'angle')} FROM z2", "z2"))
def _(spark, d):
    z = _z2(spark, d)
    return _flat(series.polar(z), "radius").join(_flat(series.polar(z, "angle"), "angle"), ["sid", "t"])


@query("wrap_phase", build("SELECT sid, t, round(CASE WHEN abs(p) > pi() THEN p - 2 * pi() * sign(p) ELSE p END, 6) + 0.0 AS v FROM (SELECT sid, t, 3 * v - 2 * pi() * floor(3 * v / (2 * pi())) AS p FROM z)", "z"))
def _(spark, d):
    return _z(spark, d).select("sid", "t", series.wrap_phase(3 * F.col("x")[0]).alias("v"))


@query("sort_with_indices", build(f"SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY v, t) - 1 AS rank, t, {r('v', 'v')} FROM ev", "ev"))
def _(spark, d):
    return series.sorted_with_indices(sources.ev_user(spark, d))


@query("integer_series", build("SELECT sid, min(CASE WHEN v = floor(v) THEN 1 ELSE 0 END)::BIGINT AS is_int FROM ev GROUP BY sid", "ev"))
def _(spark, d):
    return series.is_integer_series(sources.ev_user(spark, d))


@query("fill_linear", build(
    f"""SELECT sid, t, {r('coalesce(v, v0 + (v1 - v0) * (t - t0) / (t1 - t0), v0, v1)', 'v')} FROM (SELECT sid, t, v, last_value(v IGNORE NULLS) OVER b AS v0, first_value(v IGNORE NULLS) OVER f AS v1, last_value(u IGNORE NULLS) OVER b AS t0, first_value(u IGNORE NULLS) OVER f AS t1
    FROM (SELECT sid, t, CASE WHEN t % 4 <> 1 THEN v END AS v, CASE WHEN t % 4 <> 1 THEN t END AS u FROM ev) WINDOW b AS (PARTITION BY sid ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY sid ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))""", "ev"))  # fmt: skip
def _(spark, d):
    gaps = sources.ev_user(spark, d).select("sid", "t", F.array(F.when(F.col("t") % 4 != 1, F.col("x")[0])).alias("x"))
    return _flat(series.fill_linear(gaps), "v")


@query("matched_ends", build(
    """SELECT sid, b - a + 1 AS n FROM (SELECT p.sid, p.t AS a, q.t AS b, sum(abs(p1.v - q1.v)) AS gap FROM ev p JOIN nz USING (sid) JOIN ev q ON q.sid = p.sid AND q.t > p.t JOIN range(0, 5) g(k) ON true
    JOIN ev p1 ON p1.sid = p.sid AND p1.t = p.t + k JOIN ev q1 ON q1.sid = p.sid AND q1.t = q.t + k WHERE p.t <= floor(n * 0.01) AND q.t >= floor(n * 0.9) AND p.t + 5 <= n AND q.t + 5 <= n GROUP BY p.sid, p.t, q.t
    QUALIFY row_number() OVER (PARTITION BY p.sid ORDER BY round(gap, 9), a, b) = 1)""", "ev", "nz"))  # fmt: skip
def _(spark, d):
    return series.matched_ends(sources.ev_user(spark, d), points=5).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query("order_parameter", build(f"SELECT sid, t, {r('sqrt(power((cos(x) + cos(y)) / 2, 2) + power((sin(x) + sin(y)) / 2, 2))', 'r')} FROM z2", "z2"))
def _(spark, d):
    return series.order_parameter(_z2(spark, d))


@query("id_parse", "SELECT c_custkey AS sid, c_mktsegment AS label, 'x' || (c_custkey % 7)::VARCHAR AS grp FROM customer")
def _(spark, d):
    ids = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", F.format_string("('%s', x%d)", "c_mktsegment", F.col("c_custkey") % 7).alias("sid"))
    return sources.parse_tuple_ids(ids.select("sid").distinct(), ["label", "grp"]).join(ids, "sid").select(F.col("c_custkey").alias("sid"), "label", "grp")


@query("delay_embed", build(f"SELECT sid, t, {r('v', 'e0')}, {r('e1', 'e1')}, {r('e2', 'e2')} FROM (SELECT sid, t, v, lead(v, 2) OVER w AS e1, lead(v, 4) OVER w AS e2 FROM z WINDOW w AS (PARTITION BY sid ORDER BY t)) WHERE e2 IS NOT NULL", "z"))
def _(spark, d):
    e = embed.delay_embed(_z(spark, d), 2, 3)
    return e.select("sid", "t", *(F.col("e")[k].alias(f"e{k}") for k in range(3)))


# ------------------------------------------------------------------ plots and lines


@query("recurrence_pairs", build("SELECT sid, i, j FROM rp WHERE i > j", "rp"))
def _(spark, d):
    return _rp(spark, d)[0]


@query("recurrence_pairs_tiled", build("SELECT sid, i, j FROM rp WHERE i > j", "rp"))
def _(spark, d):
    return recurrence.recurrence_pairs(_e2(spark, d), 0.5, 2, tile=16)


@query("recurrence_pairs_by_cell", build("SELECT sid, i, j FROM rp WHERE i > j", "rp"))
def _(spark, d):
    return recurrence.recurrence_pairs_by_cell(_e2(spark, d), 0.5, 2)


@query("recurrence_rate", build(f"SELECT sid, {r('count(*)::DOUBLE / max(n * n)', 'recurrence_rate')} FROM rp JOIN sz_rp USING (sid) GROUP BY sid", "sz_rp", "rp"))
def _(spark, d):
    pairs, e = _rp(spark, d)
    return recurrence.recurrence_rate(pairs, recurrence.sizes(e))


@query("run_lengths", build("SELECT sid, line, a, b FROM dr_rp", "dr_rp"))
def _(spark, d):
    return lines.diagonal_runs(_rp(spark, d)[0])


def _hist(spark, d, kind, compat="current"):
    pairs, e = _rp(spark, d)
    runs = lines.diagonal_runs(pairs) if kind == "diag" else lines.vertical_runs(recurrence.mirrored(pairs, e))
    return lines.full_histogram(runs, recurrence.sizes(e), kind, compat)


_VERT_HIST = build("SELECT sid, len, cnt::BIGINT AS cnt FROM hv_rp UNION ALL SELECT sid, 0, (n * n - ones - runs + n)::BIGINT FROM sz_rp JOIN (SELECT sid, sum(b - a + 1) AS ones, count(*) AS runs FROM vr_rp GROUP BY sid) USING (sid) WHERE n * n - ones - runs + n > 0", "hv_rp", "sz_rp")


@query("vert_hist", _VERT_HIST)
def _(spark, d):
    return _hist(spark, d, "vert")


@query("vert_hist_legacy", _VERT_HIST)
def _(spark, d):
    return _hist(spark, d, "vert", "legacy")


@query("diag_hist", build("SELECT sid, len, cnt::BIGINT AS cnt FROM hd_rp", "hd_rp"))
def _(spark, d):
    return _hist(spark, d, "diag")


@query("diag_hist_legacy", build(
    """SELECT sid, len, sum(cnt)::BIGINT AS cnt FROM (SELECT sid, len, cnt FROM hd_rp UNION ALL SELECT sid, n, 1 FROM sz_rp
    UNION ALL SELECT sid, 0, 2 * (n * (n + 1) // 2 - (coalesce(ones, 0) + n) - (coalesce(runs, 0) + 1) + n) FROM sz_rp LEFT JOIN (SELECT sid, sum(b - a + 1) AS ones, count(*) AS runs FROM dr_rp GROUP BY sid) USING (sid)) WHERE cnt > 0 GROUP BY sid, len""", "hd_rp", "sz_rp"))  # fmt: skip
def _(spark, d):
    return _hist(spark, d, "diag", "legacy")


_MEASURES = build(o.measures("rp"), "sz_rp", "rp", "hd_rp", "hv_rp")


@query("rqa_measures", _MEASURES)
def _measures(spark, d):
    return measures.rqa_measures(_z(spark, d), 1, 2, 0.5)


for _name, _column in {
    "determinism": "determinism", "laminarity": "laminarity", "avg_diag": "average_diagonal_length", "trapping_time": "average_vertical_length", "diag_entropy": "diagonal_entropy", "vert_entropy": "vertical_entropy",
    "diag_mode": "diagonal_mode", "vert_mode": "vertical_mode", "max_diag": "max_diagonal_length", "max_vert": "max_vertical_length",
}.items():
    query(_name, f"SELECT sid, {_column} FROM ({_MEASURES})")(lambda spark, d, c=_column: _measures(spark, d).select("sid", c))


@query("rqa_measures_tiled", _MEASURES)
def _(spark, d):
    return measures.rqa_measures(_z(spark, d), 1, 2, 0.5, tile=32)


@query("rqa_measures_2d", build(o.measures("rp2d"), "sz_rp2d", "rp2d", "hd_rp2d", "hv_rp2d"))
def _(spark, d):
    return measures.rqa_measures(_z2(spark, d), 1, 2, 1.0, dims=2)


@query("rqa_measures_by_params", _MEASURES)
def _(spark, d):
    z = _z(spark, d)
    params = z.select("sid").distinct().select("sid", F.lit(1).alias("tau"), F.lit(2).alias("m"), F.lit(0.5).alias("eps"))
    return measures.rqa_measures(z, params=params)


@query("rqa_measures_legacy", build(
    f"""SELECT s.sid, {r('o.ones::DOUBLE / (s.n * s.n)', 'recc_rate')}, {r('d.share', 'percent_det')}, {r('d.mean', 'avg_diag')}, coalesce(d.mx, 1)::BIGINT AS max_diag, {r('v.share', 'percent_lam')}, {r('v.mean', 'avg_vert')}, {r('v.ent', 'vert_ent')}, {r('d.ent', 'diag_ent')}, coalesce(v.mx, 1)::BIGINT AS vert_max
    FROM sz_rp s JOIN (SELECT sid, count(*) AS ones FROM rp GROUP BY sid) o USING (sid)
    JOIN (SELECT a.*, b.mx FROM ({o.line_stats('hl', 'sid', guard='1e-7').replace(' AS mx', ' AS mx0')}) a JOIN (SELECT sid, max(CASE WHEN len <= n - 2 THEN len END) AS mx FROM hl JOIN sz_rp USING (sid) GROUP BY sid) b USING (sid)) d USING (sid)
    JOIN (SELECT a.*, b.mx FROM ({o.line_stats('hv_rp', 'sid', guard='1e-7').replace(' AS mx', ' AS mx0')}) a JOIN (SELECT sid, max(CASE WHEN len <= n - 2 THEN len END) AS mx FROM hv_rp JOIN sz_rp USING (sid) GROUP BY sid) b USING (sid)) v USING (sid)""",
    "sz_rp", "rp", "hd_rp", "hv_rp", hl="SELECT sid, len, cnt FROM hd_rp UNION ALL SELECT sid, n, 1 FROM sz_rp"))
def _(spark, d):
    return measures.rqa_measures_legacy(_z(spark, d), 1, 2, 0.5)


@query("max_diag_legacy", build("SELECT sid, coalesce(max(CASE WHEN len <= n - 2 THEN len END), 1)::BIGINT AS max_diag FROM sz_rp LEFT JOIN hd_rp USING (sid) GROUP BY sid", "sz_rp", "hd_rp"))
def _(spark, d):
    return measures.rqa_measures_legacy(_z(spark, d), 1, 2, 0.5).select("sid", "max_diag")


# ------------------------------------------------------------------ windows

_WINDOWED = build(o.WINDOWED, "sz_rp", "rp", **o.WINDOW_CTES)
_WHOLE = ("max_diagonal_length", "max_vertical_length", "diagonal_mode", "vertical_mode")


def _windowed(spark, d):
    return windows.windowed_measures(_z(spark, d), o.WINDOW, o.STEP, 1, 2, 0.5)


@query("windowed_measures", f"SELECT sid, window_start, {', '.join(f'{m}::BIGINT AS {m}' if m in _WHOLE else r(m, m) for m in measures.MEASURES)} FROM ({_WINDOWED})")
def _(spark, d):
    return _windowed(spark, d)


def _mode_sql(m: str) -> str:
    return f"(SELECT sid, min(v) AS v FROM (SELECT sid, v, rank() OVER (PARTITION BY sid ORDER BY c DESC) AS k FROM (SELECT sid, {m}::DOUBLE AS v, count(*) AS c FROM wm GROUP BY 1, 2)) WHERE k = 1 GROUP BY sid)"


_LEGACY_WIN = {k: v.replace(f", {o.STEP})", ", 1)") for k, v in o.WINDOW_CTES.items()} | {"wl": f"SELECT sid, s, len, cnt FROM wd UNION ALL SELECT sid, s, {o.WINDOW}, 1 FROM win"}


def _legacy_lines(hist: str) -> str:
    """Line statistics with the older guard, and the longest line of two points less than the window."""
    return f"(SELECT a.*, b.mx FROM ({o.line_stats(hist, 'sid, s', guard='1e-7').replace(' AS mx', ' AS mx0')}) a JOIN (SELECT sid, s, coalesce(max(CASE WHEN len <= {o.WINDOW - 2} THEN len END), 1) AS mx FROM {hist} GROUP BY sid, s) b USING (sid, s))"


@query("windowed_measures_legacy", build(
    f"""SELECT w.sid, w.s AS window_start, {r(f'o.ones::DOUBLE / {o.WINDOW ** 2}', 'recc_rate')}, {r('d.share', 'percent_det')}, {r('d.mean', 'avg_diag')}, d.mx::BIGINT AS max_diag, {r('v.share', 'percent_lam')}, {r('v.mean', 'avg_vert')}, {r('v.ent', 'vert_ent')}, {r('d.ent', 'diag_ent')}, v.mx::BIGINT AS vert_max
    FROM win w JOIN (SELECT sid, s, count(*) AS ones FROM wrp GROUP BY sid, s) o USING (sid, s) JOIN {_legacy_lines('wl')} d USING (sid, s) JOIN {_legacy_lines('wv')} v USING (sid, s)""", "sz_rp", "rp", **_LEGACY_WIN))  # fmt: skip
def _(spark, d):
    return windows.windowed_measures_legacy(_z(spark, d), o.WINDOW, 1, 2, 0.5)


_SUMMED = ("recurrence_rate", "max_diagonal_length", "vertical_mode", "diagonal_entropy")


@query("windowed_summary", f"WITH wm AS ({_WINDOWED}) SELECT a.sid, {', '.join(f'a.{m}__mean, a.{m}__median' for m in _SUMMED)}, " + ", ".join(f"round(q{k}.v, 6) + 0.0 AS {m}__mode" for k, m in enumerate(_SUMMED) if m != "diagonal_entropy") + " FROM (SELECT sid, " + ", ".join(f"{r(f'avg({m})', m + '__mean')}, {r(f'median({m})', m + '__median')}" for m in _SUMMED) + " FROM wm GROUP BY sid) a " + " ".join(f"JOIN {_mode_sql(m)} q{k} USING (sid)" for k, m in enumerate(_SUMMED) if m != "diagonal_entropy"))
def _(spark, d):
    # A mode of rounded entropies depends on their last bits, so it is left out here.
    return windows.summarise(_windowed(spark, d), measures=_SUMMED).drop("diagonal_entropy__mode")


_PICKED = "SELECT sid, determinism::DOUBLE AS v, window_start AS s, row_number() OVER (PARTITION BY sid ORDER BY window_start) - 1 AS k, count(*) OVER (PARTITION BY sid) AS n FROM wm"


@query("window_pick", f"WITH wm AS ({_WINDOWED}), p AS ({_PICKED}) SELECT sid, {r('max(CASE WHEN k = 0 THEN v END)', 'first')}, {r('max(CASE WHEN k = least(ceil(n / 2), n - 1) THEN v END)', 'middle')}, {r('max(CASE WHEN k = n - 1 THEN v END)', 'last')}, {r('max(v)', 'max')}, {r('avg(v)', 'avg')}, {r('median(v)', 'median')} FROM p GROUP BY sid")
def _(spark, d):
    return windows.picks(_windowed(spark, d), "determinism", ("first", "middle", "last", "max", "avg", "median"))


@query("continuous_mode", build(
    f"SELECT sid, {r('lo + (b + 0.5) * (hi - lo) / 10', 'mode')} FROM (SELECT sid, lo, hi, b, count(*) AS c FROM (SELECT sid, lo, hi, least(9, floor((v - lo) / (hi - lo) * 10)) AS b FROM (SELECT sid, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM ev WINDOW w AS (PARTITION BY sid))) GROUP BY sid, lo, hi, b QUALIFY row_number() OVER (PARTITION BY sid ORDER BY c DESC, b) = 1)", "ev"))
def _(spark, d):
    return windows.continuous_mode(_flat(sources.ev_user(spark, d), "v"), "sid", "v")


@query("pooled_line_hist", build(
    f"""SELECT sid, len, {r('p / sum(p) OVER (PARTITION BY sid)', 'p')}, greatest(1, floor(s / w))::BIGINT AS n_bar FROM (SELECT sid, len, sum(cnt::DOUBLE / t) AS p FROM (SELECT *, sum(cnt) OVER (PARTITION BY sid, s) AS t FROM wd) GROUP BY sid, len)
    JOIN (SELECT sid, sum(cnt) AS s FROM wd GROUP BY sid) USING (sid) JOIN (SELECT sid, n - {o.WINDOW} + 1 AS w FROM sz_rp) USING (sid)""",
    "sz_rp", "rp", **{k: v.replace(f", {o.STEP})", ", 1)") for k, v in o.WINDOW_CTES.items()}))
def _(spark, d):
    return windows.pooled_histogram(_z(spark, d), o.WINDOW, "diag", tau=1, m=2, eps=0.5)


# ------------------------------------------------------------------ information and parameters

_BINS = {
    "fd": ("FD", "ceil(power(count(*), 1 / (3 + 1e-9)) * (max(v) - min(v)) / (2 * (quantile_cont(v, 0.75) - quantile_cont(v, 0.25) + 1e-9)))"),
    "sqrt": ("sqrt", "ceil(sqrt(count(*)))"),
    "rice": ("rice", "2 * ceil(cbrt(count(*)))"),
    "sturges": ("sturges", "1 + ceil(ln(count(*)))"),
    "default": ("default", "15"),
}
for _name, (_method, _sql) in _BINS.items():
    query(f"bins_{_name}", build(f"SELECT sid, ({_sql})::BIGINT AS bins FROM ev GROUP BY sid", "ev"))(lambda spark, d, k=_method: information.bin_counts(sources.ev_user(spark, d), k))


@query("bins_doane", build("SELECT sid, ceil(2 * (1 + log2(n) + log2(1 + abs(avg(c * c * c) / power(avg(c * c), 1.5)) / sqrt(6.0 * (n - 2) / ((n + 1) * (n + 3))))) / 3)::BIGINT AS bins FROM (SELECT sid, v - avg(v) OVER w AS c, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY sid)) GROUP BY sid, n", "ev"))
def _(spark, d):
    return information.bin_counts(sources.ev_user(spark, d), "doanes")


@query("mi_curve", build(f"SELECT sid, tau, {r('mi', 'mi')} FROM mi", "z", "nz", **o.MI))
def _(spark, d):
    return information.mi_curve(_z(spark, d))


@query("mi_hist", build(f"SELECT sid, {r('mi', 'mi')} FROM mi WHERE tau = 3", "z", "nz", **o.MI))
def _(spark, d):
    return information.mi_curve(_z(spark, d), lags=[3]).select("sid", "mi")


def _mi_avg_sql() -> str:
    both = "SELECT sid, t, v, 0 AS ch FROM (SELECT sid, t, x AS v FROM z2) UNION ALL SELECT sid, t, y, 1 FROM z2"
    ctes = {"zc": both, "lg": "SELECT a.sid * 2 + a.ch AS sid, (b.t - a.t) AS tau, a.v AS x, b.v AS y FROM zc a JOIN zc b ON a.sid = b.sid AND a.ch = b.ch AND b.t - a.t = 2"}
    return build(f"SELECT sid // 2 AS sid, {r('avg(mi)', 'mi')} FROM mi GROUP BY 1", "z2", **ctes, **{k: v for k, v in o.MI.items() if k not in ("lm", "lg", "ta")})


@query("mi_avg", _mi_avg_sql())
def _(spark, d):
    return information.mi_curve(_z2(spark, d), 2, "avg", [2]).select("sid", "mi")


@query("mi_ksg", build(
    f"""SELECT sid, {r('max(pn) + 1.5 - 0.5772156649015329 - avg(px) - avg(py)', 'mi')} FROM (SELECT c.sid, c.i, p1.s AS px, p2.s AS py, p3.s AS pn FROM (SELECT sid, i, max(n) AS n, sum(CASE WHEN dx < e THEN 1 ELSE 0 END) AS nx, sum(CASE WHEN dy < e THEN 1 ELSE 0 END) AS ny
    FROM (SELECT *, max(CASE WHEN k = 3 THEN greatest(dx, dy) END) OVER (PARTITION BY sid, i) AS e FROM (SELECT *, row_number() OVER (PARTITION BY sid, i ORDER BY greatest(dx, dy)) AS k, count(*) OVER (PARTITION BY sid, i) + 1 AS n FROM kd)) GROUP BY sid, i) c
    JOIN psi p1 ON p1.m = nx + 1 JOIN psi p2 ON p2.m = ny + 1 JOIN psi p3 ON p3.m = c.n) GROUP BY sid""", "ev",
    kp="SELECT * FROM (SELECT sid, t, v AS x, lead(v) OVER (PARTITION BY sid ORDER BY t) AS y FROM ev) WHERE y IS NOT NULL", kd="SELECT a.sid, a.t AS i, sqrt((a.x - b.x) * (a.x - b.x)) AS dx, sqrt((a.y - b.y) * (a.y - b.y)) AS dy FROM kp a JOIN kp b ON a.sid = b.sid AND a.t <> b.t",
    psi="SELECT m, -0.5772156649015329 + coalesce(sum(1.0::DOUBLE / k), 0) AS s FROM range(1, 400) x(m) LEFT JOIN range(1, 400) y(k) ON k < m GROUP BY m"))
def _(spark, d):
    return information.ksg_lagged(sources.ev_user(spark, d), 1, 3)


@query("tau_first_min", build("SELECT sid, tau::BIGINT AS tau FROM ta", "z", "nz", **o.MI))
def _(spark, d):
    return information.delay(_z(spark, d))


@query("plot_mi_curve", build(f"SELECT mi.sid, mi.tau, {r('mi', 'mi')}, mi.tau = ta.tau AS is_opt FROM mi JOIN ta USING (sid)", "z", "nz", **o.MI))
def _(spark, d):
    return plotdata.mi_curve(_z(spark, d))


@query("plot_fnn_curve", build(f"SELECT sid, m, {r('sum(CASE WHEN dm < sd / 10 AND dn / dm > 10 THEN 1 ELSE 0 END) / (sum(CASE WHEN dm < sd / 10 THEN 1 ELSE 0 END) + 1e-12)', 'fnn')} FROM nb JOIN sg USING (sid) WHERE m <= 3 GROUP BY sid, m", "pz", "nz", **{k: v for k, v in o.FNN.items() if k not in ("rg", "fc", "r0")}).replace("SELECT sid, m, round", "SELECT sid, m::BIGINT AS m, round"))
def _(spark, d):
    return plotdata.fnn_curve(_z(spark, d), 1, 3)


@query("first_minimum", build("SELECT sid, coalesce(min(CASE WHEN (p IS NULL OR v < p) AND (q IS NULL OR v < q) THEN t END), arg_min(t, v))::BIGINT AS first_min FROM (SELECT sid, t, v, lag(v) OVER w AS p, lead(v) OVER w AS q FROM ev WINDOW w AS (PARTITION BY sid ORDER BY t)) GROUP BY sid", "ev"))
def _(spark, d):
    return information.first_minimum(_flat(sources.ev_user(spark, d), "v"), "t", "v")


@query("nearest_neighbour", build(f"SELECT sid, i AS t, j AS nn, {r('d', 'd')} FROM d2 WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sid, i ORDER BY d, j) = 1", "pz", "nz", d2=o.FNN["d2"]))
def _(spark, d):
    return recurrence.nearest_neighbours(_e2(spark, d), 2)


@query("fnn_ratio", build(f"SELECT sid, {r('sum(CASE WHEN dm < sd / 2 AND dn / dm > 2 THEN 1 ELSE 0 END) / (sum(CASE WHEN dm < sd / 2 THEN 1 ELSE 0 END) + 1e-12)', 'fnn')} FROM nb JOIN sg USING (sid) WHERE m = 2 GROUP BY sid", "pz", "nz", **{k: v for k, v in o.FNN.items() if k not in ("rg", "fc", "r0")}))
def _(spark, d):
    return parameters.fnn_ratio(_z(spark, d), 1, 2, 2.0)


@query("fnn_curve", build(f"SELECT sid, k AS r_index, {r('fnn', 'fnn')} FROM fc WHERE m = 2", "pz", "nz", **o.FNN))
def _(spark, d):
    return parameters.fnn_curve(_z(spark, d), 1, 2)


@query("fnn_r0", build(f"SELECT sid, m, {r('r0', 'r0')} FROM r0 WHERE m <= 3", "pz", "nz", **o.FNN))
def _(spark, d):
    return parameters.fnn_zero_upto(_z(spark, d), 1, 3)


@query("fnn_min_quantiles", build(f"SELECT m::BIGINT AS m, {r('quantile_cont(f, 0.025)', 'low')}, {r('quantile_cont(f, 0.975)', 'high')} FROM (SELECT m, sid, min(fnn) AS f FROM fc WHERE m <= 2 GROUP BY m, sid) GROUP BY m", "pz", "nz", **o.FNN))
def _(spark, d):
    z = _z(spark, d)
    curves = [parameters.fnn_curve(z, 1, m).groupBy("sid").agg(F.min("fnn").alias("f")).withColumn("m", F.lit(m)) for m in (1, 2)]
    return curves[0].unionByName(curves[1]).groupBy("m").agg(F.percentile("f", 0.025).alias("low"), F.percentile("f", 0.975).alias("high"))


@query("embedding_dim", build(
    """SELECT n.sid, coalesce(max(CASE WHEN r0 <> -1 AND nx <> -1 AND r0 - nx > 0.2 AND m <= mmax AND (m < mmax OR mmax > 1) THEN m + 1 END), greatest(1, max(mmax)))::BIGINT AS m
    FROM (SELECT sid, CASE WHEN n <= 8 THEN least(7, greatest(1, n - 1)) ELSE 7 END AS mmax FROM nz) n JOIN (SELECT *, lead(r0) OVER (PARTITION BY sid ORDER BY m) AS nx FROM r0) USING (sid) GROUP BY n.sid""", "pz", "nz", **o.FNN))  # fmt: skip
def _(spark, d):
    return parameters.embedding_dimension(_z(spark, d), 1)


@query("eps_search", build(f"SELECT s.sid, {r('coalesce(min(k) * (10.0::DOUBLE / 1000), 5.0)', 'eps')} FROM sz_rp s LEFT JOIN cv ON cv.sid = s.sid AND abs(rate - 0.1) < 0.005 GROUP BY s.sid", "sz_rp", "emb2", **{k: o.EPS[k] for k in ("pd", "cv")}))
def _(spark, d):
    return parameters.radius(_e2(spark, d), width=2)


@query("eps_group_joint", build(f"SELECT {r('coalesce(min(CASE WHEN abs(rate - 0.1) < 0.005 THEN k END) * (10.0::DOUBLE / 1000), -1.0)', 'eps')} FROM (SELECT k, avg(rate) AS rate FROM gd GROUP BY k)", "sz_rp", "emb2", **o.EPS))
def _(spark, d):
    return parameters.group_radius_joint(_e2(spark, d), width=2)


@query("eps_group_mean", build(f"SELECT floor(avg(1))::BIGINT AS tau, floor(avg(2))::BIGINT AS m, {r('avg(eps)', 'eps')} FROM (SELECT s.sid, coalesce(min(k) * (10.0::DOUBLE / 1000), 5.0) AS eps FROM sz_rp s LEFT JOIN cv ON cv.sid = s.sid AND abs(rate - 0.1) < 0.005 GROUP BY s.sid)", "sz_rp", "emb2", **{k: o.EPS[k] for k in ("pd", "cv")}))
def _(spark, d):
    return parameters.group_parameters(parameters.radius(_e2(spark, d), width=2).select("sid", "eps", F.lit(1).alias("tau"), F.lit(2).alias("m")))


# ------------------------------------------------------------------ nonlinear statistics

_ACF = {
    "a0": "SELECT sid, sum(v * v) AS s0 FROM ev GROUP BY sid",
    "ac": "SELECT a.sid, b.t - a.t AS lag, sum(a.v * b.v) / max(s0) AS acf FROM ev a JOIN ev b ON a.sid = b.sid AND b.t > a.t AND b.t - a.t < 100 JOIN a0 ON a0.sid = a.sid GROUP BY 1, 2",
    "ad": "SELECT sid, coalesce(arg_min(h, lag), 1) AS tau FROM (SELECT sid, lag, CASE WHEN acf < 0 THEN lag WHEN lag > 1 AND acf > lag(acf) OVER (PARTITION BY sid ORDER BY lag) THEN lag - 1 END AS h FROM ac) WHERE h IS NOT NULL GROUP BY sid",
}


@query("acf", build(f"SELECT sid, lag, {r('acf', 'acf')} FROM ac", "ev", **{k: _ACF[k] for k in ("a0", "ac")}))
def _(spark, d):
    return nonlinear.acf(sources.ev_user(spark, d))


@query("acf_delay", build("SELECT nz.sid, coalesce(tau, 1)::BIGINT AS tau FROM nz LEFT JOIN ad USING (sid)", "ev", "nz", **_ACF))
def _(spark, d):
    return nonlinear.acf_delay(sources.ev_user(spark, d))


@query("acf_zero", build("SELECT nz.sid, coalesce(min(lag), 1)::BIGINT AS tau FROM nz LEFT JOIN (SELECT a.sid, b.t - a.t AS lag FROM z a JOIN z b ON a.sid = b.sid AND b.t > a.t GROUP BY 1, 2 HAVING sum(a.v * b.v) < 0) USING (sid) GROUP BY nz.sid", "z", "nz"))
def _(spark, d):
    return nonlinear.acf_zero(sources.ev_user(spark, d))


@query("lyapunov", build(
    f"""SELECT s.sid, {r('CASE WHEN max(n) >= 50 THEN avg(ln(b.d / a.d) / k) END', 'lyapunov')} FROM (SELECT sid, n - 2 AS n FROM nz) s LEFT JOIN (SELECT d3.*, row_number() OVER (PARTITION BY sid, i ORDER BY d, j) AS rn FROM d3 WHERE d IS NOT NULL) a ON a.sid = s.sid AND rn = 1 AND a.i < least(n - 1, 500) AND a.d > 0
    LEFT JOIN range(1, 20) g(k) ON k < n - greatest(a.i, a.j) LEFT JOIN d3 b ON b.sid = a.sid AND b.i = a.i + k AND b.j = a.j + k AND b.d > 0 GROUP BY s.sid""", "pz", "nz", d3=o.FNN["d3"]))  # fmt: skip
def _(spark, d):
    return nonlinear.lyapunov(_z(spark, d))


@query("time_irreversibility", build(
    f"SELECT nz.sid, {r('sqrt(avg(d * d))', 'irreversibility')} FROM nz LEFT JOIN (SELECT a.sid, b.t - a.t AS lag, avg(b.v * a.v * a.v) - avg(a.v * b.v * b.v) AS d FROM c a JOIN c b ON a.sid = b.sid AND b.t > a.t GROUP BY 1, 2) l ON l.sid = nz.sid AND lag < least(n // 10, 20) GROUP BY nz.sid", "ev", "nz", c="SELECT sid, t, v - avg(v) OVER (PARTITION BY sid) AS v FROM ev"))
def _(spark, d):
    return nonlinear.time_irreversibility(sources.ev_user(spark, d))


@query("time_irreversibility_cubic", build(f"SELECT sid, {r('sum(d * d * d) / count(*)', 'irreversibility')} FROM (SELECT sid, lead(v) OVER (PARTITION BY sid ORDER BY t) - v AS d FROM ev) GROUP BY sid", "ev"))
def _(spark, d):
    return nonlinear.time_irreversibility_cubic(sources.ev_user(spark, d))


def _phi(k: int) -> str:
    near = " AND ".join(f"abs(a.v{x} - b.v{x}) <= r" for x in range(k))
    return f"SELECT sid, avg(ln(c / n::DOUBLE)) AS phi FROM (SELECT a.sid, a.t, count(*) AS c, max(n - {k - 1}) AS n FROM t3 a JOIN t3 b ON a.sid = b.sid AND a.v{k - 1} IS NOT NULL AND b.v{k - 1} IS NOT NULL JOIN rr ON rr.sid = a.sid AND {near} GROUP BY a.sid, a.t) GROUP BY sid"


@query("sample_entropy", build(f"SELECT sid, {r('p2.phi - p3.phi', 'entropy')} FROM p2 JOIN p3 USING (sid)", "z", rr="SELECT sid, 0.2 * stddev_pop(v) AS r, count(*) AS n FROM z GROUP BY sid", t3="SELECT sid, t, v AS v0, lead(v) OVER w AS v1, lead(v, 2) OVER w AS v2 FROM z WINDOW w AS (PARTITION BY sid ORDER BY t)", p2=_phi(2), p3=_phi(3)))
def _(spark, d):
    return nonlinear.sample_entropy(_z(spark, d))


@query("correlation_dimension", build(
    f"""SELECT b.sid::BIGINT AS sid, {r('regr_slope(y, x)', 'dimension')} FROM base b LEFT JOIN (SELECT sid, ln(power(10.0, -2 + 2 * k / 19.0) * max(sd)) AS x, ln(greatest(avg(CASE WHEN d < power(10.0, -2 + 2 * k / 19.0) * sd THEN 1.0 ELSE 0.0 END), 1e-10)) AS y FROM dd CROSS JOIN range(0, 20) g(k) GROUP BY sid, k) p USING (sid) GROUP BY b.sid""", "od",
    ev="SELECT * FROM od", **_ACF, base="SELECT sid, stddev_pop(v) AS sd, count(*) AS n FROM od GROUP BY sid",
    e5="SELECT a.sid, a.t, a.v AS v0, b.v AS v1, c.v AS v2, d.v AS v3, e.v AS v4 FROM od a JOIN ad USING (sid) JOIN od b ON b.t = a.t + tau JOIN od c ON c.t = a.t + 2 * tau JOIN od d ON d.t = a.t + 3 * tau JOIN od e ON e.t = a.t + 4 * tau WHERE a.t < 200",
    dd="SELECT a.sid, sd, sqrt(power(a.v0 - b.v0, 2) + power(a.v1 - b.v1, 2) + power(a.v2 - b.v2, 2) + power(a.v3 - b.v3, 2) + power(a.v4 - b.v4, 2)) AS d FROM e5 a JOIN e5 b ON a.sid = b.sid AND a.t % 5 = 0 AND b.t > a.t AND (b.t - a.t) % 5 = 1 JOIN base ON base.sid = a.sid"))
def _(spark, d):
    return nonlinear.correlation_dimension(sources.ord_daily(spark, d))


@query("correlation_sum", build(f"SELECT a.sid, r::DOUBLE AS r, {r('avg(CASE WHEN greatest(abs(a.e0 - b.e0), abs(a.e1 - b.e1)) < r THEN 1.0 ELSE 0.0 END)', 'c')} FROM emb2 a JOIN emb2 b ON a.sid = b.sid AND a.t - b.t > 10 CROSS JOIN (VALUES (0.25), (0.5), (1.0)) g(r) GROUP BY a.sid, r", "emb2"))
def _(spark, d):
    return nonlinear.correlation_sum(_e2(spark, d), [0.25, 0.5, 1.0], width=2)


@query("nonlinearity_index", build(f"SELECT sid, {r('abs(avg(c * c * c) / power(avg(c * c), 1.5))', 'nonlinearity')} FROM (SELECT sid, d - avg(d) OVER (PARTITION BY sid) AS c FROM (SELECT sid, lead(v) OVER (PARTITION BY sid ORDER BY t) - v AS d FROM ev) WHERE d IS NOT NULL) GROUP BY sid", "ev"))
def _(spark, d):
    return nonlinear.nonlinearity_index(sources.ev_user(spark, d))


@query("predictability", build(f"SELECT sid, {r('CASE WHEN max(n) >= 20 THEN avg(CASE WHEN t >= 10 AND t <= n - 2 THEN abs(v - (2 * p1 - p2)) END) / stddev_pop(v) END', 'predictability')} FROM (SELECT sid, t, v, lag(v) OVER w AS p1, lag(v, 2) OVER w AS p2, n FROM ev JOIN nz USING (sid) WINDOW w AS (PARTITION BY sid ORDER BY t)) GROUP BY sid", "ev", "nz"))
def _(spark, d):
    return nonlinear.predictability(sources.ev_user(spark, d))


_CHI2 = "sum(power(h - (ceil(n / 2) / n * q + 1e-9), 2) / (ceil(n / 2) / n * q + 1e-9))"
_CHI2_CELLS = """(SELECT x.sid, b, x.n, coalesce(q, 0) AS q, coalesce(h, 0) AS h FROM (SELECT sid, n, b FROM nz CROSS JOIN range(0, 10) g(b)) x
    LEFT JOIN (SELECT sid, b, count(*) AS q, sum(CASE WHEN t < ceil(n / 2) THEN 1 ELSE 0 END) AS h FROM (SELECT sid, t, n, least(9, floor((v - lo) / (hi - lo) * 10)) AS b FROM (SELECT *, min(v) OVER (PARTITION BY sid) AS lo, max(v) OVER (PARTITION BY sid) AS hi FROM ev JOIN nz USING (sid))) GROUP BY sid, b) y USING (sid, b))"""


@query("chi2_stationarity", build(f"SELECT sid, {r(_CHI2, 'chi2')} FROM {_CHI2_CELLS} GROUP BY sid", "ev", "nz"))
def _(spark, d):
    return nonlinear.chi2_stationarity(sources.ev_user(spark, d))


# The lower incomplete gamma function by its power series; 9 degrees of freedom.
@query("chi2_p_value", build(f"SELECT sid, {r('chi2', 'chi2')}, {r('1 - list_sum(list_transform(range(0, 400), lambda j: exp((4.5 + j) * ln(chi2 / 2) - chi2 / 2 - lgamma(5.5 + j))))', 'p')} FROM (SELECT sid, {_CHI2} AS chi2 FROM {_CHI2_CELLS} GROUP BY sid)", "ev", "nz"))
def _(spark, d):
    return nonlinear.chi2_stationarity(sources.ev_user(spark, d)).withColumn("p", special.chi2_p_value(F.col("chi2"), F.lit(9)))


_PG = "SELECT sid, k, max(n) AS n, (power(sum(v * cos(2 * pi() * ((k * t) % n) / n)), 2) + power(sum(v * sin(2 * pi() * ((k * t) % n) / n)), 2)) / max(n) AS power FROM (SELECT sid, t, v - avg(v) OVER (PARTITION BY sid) AS v FROM ev) JOIN nz USING (sid) CROSS JOIN range(1, 200) g(k) WHERE k <= n // 2 GROUP BY sid, k"


@query("periodogram", build(f"SELECT sid, k, {r('k::DOUBLE / n', 'f')}, round(power, 4) + 0.0 AS power FROM pg", "ev", "nz", pg=_PG))
def _(spark, d):
    return nonlinear.periodogram(sources.ev_user(spark, d)).withColumn("power", F.round("power", 4))


@query("periodogram_slope", build(f"SELECT sid, {r('-regr_slope(log10(power), log10(k::DOUBLE / n))', 'beta')} FROM pg WHERE power > 0 GROUP BY sid", "ev", "nz", pg=_PG))
def _(spark, d):
    return nonlinear.noise_colour(sources.ev_user(spark, d))


@query("henon_orbit", f"WITH RECURSIVE h(t, x, y) AS (SELECT 0::BIGINT, 0.1::DOUBLE, 0.1::DOUBLE UNION ALL SELECT t + 1, 1 - 1.4::DOUBLE * x * x + y, 0.3::DOUBLE * x FROM h WHERE t < 24) SELECT t, {r('x', 'x')}, {r('y', 'y')} FROM h")
def _(spark, d):
    return spark.range(1).select(F.posexplode(F.expr(nonlinear.henon(25))).alias("t", "p")).select("t", "p.x", "p.y")


# ------------------------------------------------------------------ scores, tests and features


@query("regime_thresholds", "SELECT system, param, round(threshold::DOUBLE, 6) + 0.0 AS threshold, below, above FROM (VALUES ('rossler', 'c', 4.2, 'periodic', 'chaotic'), ('lorenz', 'rho', 24.74, 'fixed_point', 'chaotic'), ('henon', 'a', 1.06, 'periodic', 'chaotic'), ('chua', 'alpha', 8.8, 'periodic', 'chaotic'), ('kuramoto', 'K', sqrt(8 / pi()), 'incoherent', 'synchronized')) t(system, param, threshold, below, above)")
def _(spark, d):
    return generate.regime_table(spark)


_PT = {
    "pt": "SELECT vec_id AS id, label, embedding::DOUBLE[] AS f FROM embeddings",
    "lp": "SELECT id, label, unnest(range(1, len(f) + 1)) AS pos, unnest(f) AS v FROM pt",
    "ce": "SELECT label, pos, avg(v) AS c, count(*) AS n FROM lp GROUP BY label, pos",
    "nbm": "SELECT label, pos, avg(v) AS m, var_pop(v) + 1e-9 * (SELECT max(s) FROM (SELECT var_pop(v) AS s FROM lp GROUP BY pos)) AS s2, count(*)::DOUBLE / (SELECT count(*) FROM pt) AS prior FROM lp GROUP BY label, pos",
    "nbp": "SELECT id, label AS yhat FROM (SELECT lp.id, m.label, sum(-0.5 * ln(2 * pi() * s2) - (v - m) * (v - m) / (2 * s2)) + max(ln(prior)) AS l FROM lp JOIN nbm m USING (pos) GROUP BY lp.id, m.label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY l DESC, label) = 1",
}


@query("knn_predict", build("SELECT id, label::BIGINT AS yhat FROM (SELECT id, label, count(*) AS c FROM (SELECT a.id, b.label FROM pt a JOIN pt b ON a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.f, b.f), b.id) <= 5) GROUP BY id, label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, label) = 1", pt=_PT["pt"]))
def _(spark, d):
    p = _points(spark, d)
    return stats.knn_predict(p, p, 5, leave_one_out=True)


def _nb(spark, d):
    p = _points(spark, d)
    return stats.gaussian_nb_predict(p, p).join(p.select("id", F.col("label").alias("y")), "id")


@query("gaussian_nb_predict", build("SELECT id, yhat::BIGINT AS yhat, label::BIGINT AS y FROM nbp JOIN pt USING (id)", **_PT))
def _(spark, d):
    return _nb(spark, d)


@query("confusion_matrix", build("SELECT label::BIGINT AS y, yhat::BIGINT AS yhat, count(*) AS n FROM nbp JOIN pt USING (id) GROUP BY 1, 2", **_PT))
def _(spark, d):
    return stats.confusion(_nb(spark, d))


@query("accuracy_f1", build(f"SELECT {r('sum(tp) / sum(n)', 'accuracy')}, {r('avg(CASE WHEN n > 0 THEN tp / n END)', 'balanced_accuracy')}, {r('avg(2 * tp / (n + k))', 'f1_macro')} FROM (SELECT c, sum(CASE WHEN label = c THEN 1 ELSE 0 END)::DOUBLE AS n, sum(CASE WHEN yhat = c THEN 1 ELSE 0 END) AS k, sum(CASE WHEN label = c AND yhat = c THEN 1 ELSE 0 END) AS tp FROM nbp JOIN pt USING (id) CROSS JOIN (SELECT DISTINCT label AS c FROM pt) GROUP BY c)", **_PT))
def _(spark, d):
    return stats.classification_scores(_nb(spark, d))


@query("roc_auc", build(f"SELECT {r('(sum(CASE WHEN label = 0 THEN rk END) - max(p) * (max(p) + 1) / 2.0) / (max(p) * (max(n) - max(p)))', 'auc')} FROM (SELECT label, rank() OVER (ORDER BY f[1]) + (count(*) OVER (PARTITION BY f[1]) - 1) / 2.0 AS rk, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) OVER () AS p, count(*) OVER () AS n FROM pt)", pt=_PT["pt"]))
def _(spark, d):
    return stats.roc_auc(_points(spark, d).withColumn("s", F.col("features")[0]), "s", F.col("label") == 0)


@query("silhouette", build(f"SELECT {r('avg(CASE WHEN own IS NULL THEN 0 ELSE (other - own) / greatest(own, other) END)', 'score')} FROM (SELECT id, min(CASE WHEN la = lb THEN m END) AS own, min(CASE WHEN la <> lb THEN m END) AS other FROM (SELECT a.id, a.label AS la, b.label AS lb, avg(list_distance(a.f, b.f)) AS m FROM pt a JOIN pt b ON a.id <> b.id GROUP BY 1, 2, 3) GROUP BY id)", pt=_PT["pt"]))
def _(spark, d):
    return stats.silhouette(_points(spark, d))


_DISP = {**{k: _PT[k] for k in ("pt", "lp", "ce")}, "mu": "SELECT pos, avg(v) AS m FROM lp GROUP BY pos"}


@query("calinski_harabasz", build(f"SELECT {r('(b / (k - 1)) / (w / (n - k))', 'score')} FROM (SELECT sum(power(v - c, 2)) AS w FROM lp JOIN ce USING (label, pos)), (SELECT sum(n * power(c - m, 2)) AS b FROM ce JOIN mu USING (pos)), (SELECT count(*) AS n, count(DISTINCT label) AS k FROM pt)", **_DISP))
def _(spark, d):
    return stats.calinski_harabasz(_points(spark, d))


@query("davies_bouldin", build(f"SELECT {r('avg(q)', 'score')} FROM (SELECT la, max((s1.s + s2.s) / g) AS q FROM (SELECT a.label AS la, b.label AS lb, sqrt(sum(power(a.c - b.c, 2))) AS g FROM ce a JOIN ce b ON a.pos = b.pos AND a.label <> b.label GROUP BY 1, 2) JOIN sp s1 ON s1.label = la JOIN sp s2 ON s2.label = lb GROUP BY la)", **{k: _PT[k] for k in ("pt", "lp", "ce")}, sp="SELECT label, avg(e) AS s FROM (SELECT label, id, sqrt(sum(power(v - c, 2))) AS e FROM lp JOIN ce USING (label, pos) GROUP BY 1, 2) GROUP BY label"))
def _(spark, d):
    return stats.davies_bouldin(_points(spark, d))


@query("adjusted_rand", build(f"SELECT {r('(s - sa * sb / t) / ((sa + sb) / 2 - sa * sb / t)', 'ari')} FROM (SELECT sum(n * (n - 1) / 2.0) AS s FROM cl), (SELECT sum(n * (n - 1) / 2.0) AS sa FROM (SELECT sum(n) AS n FROM cl GROUP BY a)), (SELECT sum(n * (n - 1) / 2.0) AS sb FROM (SELECT sum(n) AS n FROM cl GROUP BY b)), (SELECT sum(n) * (sum(n) - 1) / 2.0 AS t FROM cl)", cl="SELECT label AS a, floor(embedding[1]::DOUBLE * 4) AS b, count(*) AS n FROM embeddings GROUP BY 1, 2"))
def _(spark, d):
    return stats.adjusted_rand(_points(spark, d).select("label", F.floor(F.col("features")[0] * 4).alias("b")), "label", "b")


_TESTS = {
    "um": "SELECT user_id, event_type, avg(value) AS value FROM events GROUP BY 1, 2",
    "re": "SELECT event_type, median(value) AS value FROM events GROUP BY 1",
    "pv": "SELECT event_type, (sum(CASE WHEN um.value >= re.value THEN 1 ELSE 0 END) + 1)::DOUBLE / (count(*) + 1) AS p FROM re JOIN um USING (event_type) GROUP BY 1",
}


def _real_null(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy("event_type").agg(F.percentile("value", 0.5).alias("value")), e.groupBy("user_id", "event_type").agg(F.avg("value").alias("value"))


def _p(spark, d):
    real, null = _real_null(spark, d)
    return stats.rank_p_value(real, null, ("event_type",))


@query("rank_p_value", build(f"SELECT event_type, {r('p', 'p')} FROM pv", **_TESTS))
def _(spark, d):
    return _p(spark, d)


@query("benjamini_hochberg", build(f"SELECT event_type, {r('p', 'p')}, {r('q', 'p_adjusted')}, q <= 0.05 AS significant FROM (SELECT event_type, p, least(1.0, min(p * m / k) OVER (ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS m FROM pv))", **_TESTS))
def _(spark, d):
    return stats.benjamini_hochberg(_p(spark, d))


@query("bonferroni", build(f"SELECT event_type, {r('p', 'p')}, {r('least(1.0, p * count(*) OVER ())', 'p_adjusted')}, least(1.0, p * count(*) OVER ()) <= 0.05 AS significant FROM pv", **_TESTS))
def _(spark, d):
    return stats.bonferroni(_p(spark, d))


@query("cohens_d", build(f"SELECT event_type, {r('(re.value - m) / greatest(s, 1e-12)', 'd')} FROM re JOIN (SELECT event_type, avg(value) AS m, stddev_pop(value) AS s FROM um GROUP BY 1) USING (event_type)", **_TESTS))
def _(spark, d):
    return stats.cohens_d(*_real_null(spark, d), ("event_type",))


@query("wilcoxon_w", build(
    f"""SELECT sid, {r('coalesce(least(up, down), 0)', 'statistic')}, {r('CASE WHEN up IS NULL THEN 0 ELSE 1 - 2 * least(up, down) / (n * (n + 1) / 2.0) END', 'effect_size')} FROM (SELECT sid, count(*) AS n FROM wd GROUP BY sid) LEFT JOIN
    (SELECT sid, sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS up, sum(CASE WHEN d < 0 THEN k ELSE 0 END) AS down FROM (SELECT sid, d, rank() OVER (PARTITION BY sid ORDER BY abs(d)) + (count(*) OVER (PARTITION BY sid, abs(d)) - 1) / 2.0 AS k FROM wd WHERE d <> 0) GROUP BY sid) USING (sid)""",
    "ev", wd="SELECT sid, v - w AS d FROM (SELECT sid, v, lead(v) OVER (PARTITION BY sid ORDER BY t) AS w FROM ev) WHERE w IS NOT NULL"))
def _(spark, d):
    ev = _flat(sources.ev_user(spark, d), "v")
    nxt = ev.select("sid", "v", F.lead("v").over(series.in_time()).alias("w")).where("w is not null")
    return stats.wilcoxon(nxt, "v", "w", ("sid",))


_FEATURES = tuple(m for m in measures.MEASURES)


@query("feature_table", f"WITH m AS ({_MEASURES}), wm AS ({_WINDOWED}) SELECT m.sid AS id, {', '.join('m.' + c for c in _FEATURES)}, {', '.join(f'w.win_{c}__mean, w.win_{c}__median' for c in _FEATURES)}, 1::BIGINT AS tau, 2::BIGINT AS m, 0.5::DOUBLE AS eps FROM m LEFT JOIN (SELECT sid, {', '.join(r(f'avg({c})', f'win_{c}__mean') + ', ' + r(f'median({c})', f'win_{c}__median') for c in _FEATURES)} FROM wm GROUP BY sid) w USING (sid)")
def _(spark, d):
    return features.feature_table(sources.ev_user(spark, d), o.WINDOW, o.STEP, ("mean", "median"), tau=1, m=2, eps=0.5)


# The other queries register themselves.
from . import kernel_queries, legacy_queries, model_queries  # noqa: E402, F401
