"""Queries of the numerical kernels. What they draw comes from digests of keys and counters
(`functions.hashrng`), so DuckDB can draw it again and work the results out independently."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators import generate, nonlinear, plotdata
from ..sources import series as sources
from .oracles import build, r
from .registry import flat, query, z


def u(key: str, i: str) -> str:
    """SQL of number i of a key."""
    return f"(('0x' || substr(md5({key} || '|' || ({i})), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal(key: str, i: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u(key, f'2 * ({i})')})) * cos(2 * pi() * {u(key, f'2 * ({i}) + 1')}))"


def _key(kind: str) -> str:
    return f"('42|{kind}|' || sid || '|0')"


_ANGLE = "2 * pi() * ((k * t) % n) / n"
_C = "SELECT sid, t, n, v - avg(v) OVER (PARTITION BY sid) AS v FROM ev JOIN nz USING (sid)"


def _spectrum(of: str) -> str:
    """sum of v cos and v sin of each frequency."""
    return f"SELECT sid, n, k, sum(v * cos({_ANGLE})) AS c, sum(v * sin({_ANGLE})) AS s FROM {of} CROSS JOIN range(0, 1000) g(k) WHERE k <= n // 2 GROUP BY sid, n, k"


def _phased(times: str, spectrum: str, phase: str) -> str:
    """The series with a spectrum's amplitudes and other phases."""
    return f"""SELECT x.sid, x.t, x.n, sum(CASE WHEN k = 0 OR 2 * k = x.n THEN cos(phi) * cos(2 * pi() * ((k * x.t) % x.n) / x.n) ELSE 2 * cos(2 * pi() * ((k * x.t) % x.n) / x.n + phi) END * a) / x.n AS v
        FROM {times} x JOIN (SELECT sid, n, k, sqrt(c * c + s * s) AS a, 2 * pi() * {phase} AS phi FROM {spectrum}) p ON p.sid = x.sid GROUP BY x.sid, x.t, x.n"""


def _ft_sql() -> str:
    return build(f"SELECT sid, 0::BIGINT AS rep, t, {r('v', 'v')} FROM ({_phased('c', 'f', u(_key('FT'), 'k'))})", "ev", "nz", c=_C, f=_spectrum("c"))


def _aaft_sql() -> str:
    rank = "row_number() OVER (PARTITION BY sid ORDER BY v, t)"
    return build(
        f"SELECT s.sid, 0::BIGINT AS rep, s.t, {r('c.v - min(c.v) OVER (PARTITION BY s.sid)', 'v')} FROM (SELECT *, {rank} AS k FROM y) s JOIN (SELECT sid, v, {rank} AS k FROM c) c ON c.sid = s.sid AND c.k = s.k", "ev", "nz", c=_C,
        g=f"SELECT x.sid, x.t, x.n, g.v FROM (SELECT *, {rank} AS k FROM c) x JOIN (SELECT sid, v, {rank} AS k FROM (SELECT sid, t, {normal(_key('AAFT'), 't')} AS v FROM c)) g ON g.sid = x.sid AND g.k = x.k",
        f=_spectrum("g"), y=_phased("g", "f", u(_key("AAFT"), "2 * n + k")))


_RP = build(f"SELECT sid, 0::BIGINT AS rep, row_number() OVER (PARTITION BY sid ORDER BY {u(_key('RP'), 't')}) - 1 AS t, {r('v', 'v')} FROM ev", "ev")
_TSHIFT = build(f"SELECT sid, 0::BIGINT AS rep, (t + floor({u(_key('tshift'), '0')} * n)::BIGINT) % n AS t, {r('v', 'v')} FROM ev JOIN nz USING (sid)", "ev", "nz")


def _reordered(kind: str, parts: str) -> str:
    """Series cut into parts q = 0 .. np whose inner ones are put in another order, if there are two or more."""
    place = f"CASE WHEN np < 3 OR q = 0 OR q = np THEN q::DOUBLE ELSE {u(_key(kind), 'q - 1')} END"
    # Inner parts are in order of their draws, between the first and the last part.
    return f"SELECT sid, 0::BIGINT AS rep, row_number() OVER (PARTITION BY sid ORDER BY CASE WHEN q = 0 THEN 0 WHEN q = np THEN 2 ELSE 1 END, {place}, t) - 1 AS t, {r('v', 'v')} FROM ({parts})"


_CSS = build(_reordered("CSS", """SELECT sid, t, v, q, max(q) OVER (PARTITION BY sid) AS np FROM (SELECT sid, t, v, sum(CASE WHEN v > p AND v >= x AND v > m THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t) AS q
    FROM (SELECT sid, t, v, lag(v) OVER w AS p, lead(v) OVER w AS x, avg(v) OVER (PARTITION BY sid) AS m FROM ev WINDOW w AS (PARTITION BY sid ORDER BY t)))"""), "ev")  # fmt: skip
_W = "CASE WHEN k = 0 OR 2 * k = x.n THEN 1 ELSE 2 END"
_CPP = build(
    _reordered("CPP", "SELECT sid, t, v, q, max(q) OVER (PARTITION BY sid) AS np FROM (SELECT sid, t, v, sum(CASE WHEN v - p < -pi() THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY t) AS q FROM (SELECT sid, t, v, lag(v) OVER (PARTITION BY sid ORDER BY t) AS p FROM a))"),
    "ev", "nz", c=_C, f=_spectrum("c"),
    a=f"SELECT x.sid, x.t, atan2(sum({_W} * (c * sin(2 * pi() * ((k * t) % x.n) / x.n) - s * cos(2 * pi() * ((k * t) % x.n) / x.n))), sum({_W} * (c * cos(2 * pi() * ((k * t) % x.n) / x.n) + s * sin(2 * pi() * ((k * t) % x.n) / x.n)))) AS v FROM c x JOIN f ON f.sid = x.sid GROUP BY x.sid, x.t")


def _made(kind: str, legacy: bool):
    def run(spark, d):
        out = flat(generate.surrogates(sources.ev_user(spark, d), kind, 1, legacy=legacy), "v", keys=("sid", "rep", "t"))
        # Centred values that were rounded to begin with are shown over the least: they are ties of rounding else.
        return out.withColumn("v", F.col("v") - F.min("v").over(W.partitionBy("sid"))) if kind == "AAFT" else out

    return run


_DRAWN = {"FT": _ft_sql(), "AAFT": _aaft_sql(), "RP": _RP, "tshift": _TSHIFT, "CSS": _CSS, "CPP": _CPP}
for _kind in kernels.SURROGATES:
    query(f"surrogate_{_kind.lower()}", _DRAWN.get(_kind))(_made(_kind, False))
for _kind in kernels.LEGACY_SURROGATES:
    query(f"surrogate_legacy_{_kind.lower()}", _DRAWN.get(_kind))(_made(_kind, True))

#: Kinds that keep the values, and kinds that keep the power spectrum: what no draw can change.
_VALUES = (("AAFT", False), ("IAAFT", False), ("IDFS", False), ("IAAFT1", True), ("RP", True), ("tshift", True), ("CSS", True))
_SPECTRA = (("FT", False), ("tshift", True))


@query("surrogate_values", build(
    f"SELECT kind, sid, row_number() OVER (PARTITION BY kind, sid ORDER BY v) AS k, {r('v - min(v) OVER (PARTITION BY kind, sid)', 'v')} FROM ev CROSS JOIN (VALUES {', '.join(f"('{k}')" for k, _ in _VALUES)}) g(kind)", "ev"))
def _(spark, d):
    ev = sources.ev_user(spark, d)
    out = None
    for kind, legacy in _VALUES:
        one = generate.surrogates(ev, kind, 1, legacy=legacy)
        out = one if out is None else out.unionByName(one)
    # Over the least value: what is centred on a mean would be rounded either way now and then.
    w, v = W.partitionBy("kind", "sid"), F.col("x")[0]
    return out.select("kind", "sid", F.row_number().over(w.orderBy(v)).alias("k"), (v - F.min(v).over(w)).alias("v"))


@query("surrogate_spectra", build(f"SELECT kind, sid, k, round(sqrt((c * c + s * s) / n), 5) + 0.0 AS amplitude FROM f CROSS JOIN (VALUES {', '.join(f"('{k}')" for k, _ in _SPECTRA)}) g(kind) WHERE k > 0 AND 2 * k < n", "ev", "nz", c=_C, f=_spectrum("c")))
def _(spark, d):
    ev, out = sources.ev_user(spark, d), None
    size = ev.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    for kind, legacy in _SPECTRA:
        one = nonlinear.periodogram(generate.surrogates(ev, kind, 1, legacy=legacy).select("sid", "t", "x")).join(size, "sid").where("2 * k < n").select(F.lit(kind).alias("kind"), "sid", "k", F.round(F.sqrt("power"), 5).alias("amplitude"))
        out = one if out is None else out.unionByName(one)
    return out


# ------------------------------------------------------------------ systems

#: Equations of the flows, x, y, z in SQL; fixed values.
_FLOWS = {
    "rossler": (("-{y} - {z}", "{x} + 0.2::DOUBLE * {y}", "0.2::DOUBLE + {z} * ({x} - 5.7::DOUBLE)"), 1.0),
    "lorenz": (("10.0::DOUBLE * ({y} - {x})", "{x} * (28.0::DOUBLE - {z}) - {y}", "{x} * {y} - (8.0::DOUBLE / 3) * {z}"), 1.0),
    "chua": (("15.6::DOUBLE * ({y} - {x} - (-0.714::DOUBLE * {x} + 0.5::DOUBLE * (-1.143::DOUBLE - -0.714::DOUBLE) * (abs({x} + 1) - abs({x} - 1))))", "{x} - {y} + {z}", "-28.0::DOUBLE * {y}"), 0.1),
}


def _flow_sql(system: str, n: int = 200, stride: int = 10, span: float = 20.0, parts: int = 101) -> str:
    """Runge-Kutta steps one after the other; every parts-th state is a sample."""
    equations, start = _FLOWS[system]

    def slopes(name: str, at: str) -> str:
        p = {v: f"({v}{at.format(v=v)})" for v in "xyz"}
        return ", ".join(f"{e.format(**p)} AS {name}{v}" for v, e in zip("xyz", equations))

    step = f"{span}::DOUBLE / {n * stride - 1}"
    inner = f"SELECT *, ((i // {parts} + 1) * {stride} * ({step}) - (i // {parts}) * {stride} * ({step})) / {parts} AS h FROM s WHERE i < {(n - 1) * parts}"
    for name, at in (("k1", ""), ("k2", " + h / 2 * k1{v}"), ("k3", " + h / 2 * k2{v}"), ("k4", " + h * k3{v}")):
        inner = f"SELECT *, {slopes(name, at)} FROM ({inner})"
    new = ", ".join(f"{v} + h / 6 * (k1{v} + 2 * k2{v} + 2 * k3{v} + k4{v})" for v in "xyz")
    first = ", ".join([f"{start}::DOUBLE"] * 3)
    return f"WITH RECURSIVE s(i, x, y, z) AS (SELECT 0::BIGINT, {first} UNION ALL SELECT i + 1, {new} FROM ({inner})) SELECT sid, i // {parts} AS t, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM s CROSS JOIN range(2) g(sid) WHERE i % {parts} = 0"


def _simulated(system: str, *names: str, n: int = 200):
    return lambda spark, d: flat(generate.simulate(spark.range(2).select(F.col("id").alias("sid")), system, n, tmax=2000), *names)


for _system in _FLOWS:
    query(f"simulate_{_system}", _flow_sql(_system))(_simulated(_system, "x", "y", "z"))
query("simulate_henon", f"WITH RECURSIVE h(t, x, y) AS (SELECT 0::BIGINT, 0.1::DOUBLE, 0.1::DOUBLE UNION ALL SELECT t + 1, 1 - 1.4::DOUBLE * x * x + y, 0.3::DOUBLE * x FROM h WHERE t < 199) SELECT sid, t, {r('x', 'x')}, {r('y', 'y')} FROM h CROSS JOIN range(2) g(sid)")(_simulated("henon", "x", "y"))
query("simulate_sine", f"SELECT sid, t, {r('sin(t * (8 * pi() / 199))', 'x')} FROM range(2) g(sid) CROSS JOIN range(200) h(t)")(_simulated("sine", "x"))
query("simulate_white_noise", f"SELECT sid, t, {r(normal("('42|' || sid)", 't'), 'x')} FROM range(2) g(sid) CROSS JOIN range(200) h(t)")(_simulated("white_noise", "x"))


def _kuramoto_sql(n: int = 100, osc: int = 10, tmax: float = 100.0) -> str:
    parts = -int(-(tmax / (n - 1) / 0.02 - 1e-9) // 1)
    key, step = "('42|' || sid)", f"({tmax}::DOUBLE / {n - 1})"

    def slope(at: str) -> str:
        # The mean field of all oscillators, then each one's pull towards it.
        re, im = f"list_avg(list_transform({at}, lambda q: cos(q)))", f"list_avg(list_transform({at}, lambda q: sin(q)))"
        return f"(SELECT list_transform(range(1, {osc + 1}), lambda j: w[j] + 1.0 * ({im} * cos({at}[j]) - {re} * sin({at}[j]))))"

    moved = lambda by, k: f"list_transform(range(1, {osc + 1}), lambda j: th[j] + {by} * {k}[j])"
    inner = f"SELECT *, ((i // {parts} + 1) * {step} - (i // {parts}) * {step}) / {parts} AS h FROM s WHERE i < {(n - 1) * parts}"
    inner = f"SELECT *, th AS p1 FROM ({inner})"
    for k, by in ((1, "h / 2"), (2, "h / 2"), (3, "h"), (4, None)):
        inner = f"SELECT *, {slope(f'p{k}')} AS k{k} FROM ({inner})"
        if by:
            inner = f"SELECT *, {moved(by, f'k{k}')} AS p{k + 1} FROM ({inner})"
    new = f"list_transform(range(1, {osc + 1}), lambda j: th[j] + h / 6 * (k1[j] + 2 * k2[j] + 2 * k3[j] + k4[j]))"
    first = f"SELECT sid, 0::BIGINT AS i, list_transform(range({osc}), lambda j: {normal(key, 'j')}) AS w, list_transform(range({osc}), lambda j: 2 * pi() * {u(key, f'{2 * osc} + j')}) AS th FROM range(2) g(sid)"
    cols = ", ".join(r(f"sin(th[{j + 1}])", f"x{j}") for j in range(osc))
    return f"WITH RECURSIVE s(sid, i, w, th) AS ({first} UNION ALL SELECT sid, i + 1, w, {new} FROM ({inner})) SELECT sid, i // {parts} AS t, {cols} FROM s WHERE i % {parts} = 0"


query("simulate_kuramoto", _kuramoto_sql())(_simulated("kuramoto", *(f"x{j}" for j in range(10)), n=100))
query("simulate_euler", f"WITH RECURSIVE s(t, x, y, z) AS (SELECT 0::BIGINT, 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL SELECT t + 1, x + 0.0001::DOUBLE * (-y - z), y + 0.0001::DOUBLE * (x + 0.2::DOUBLE * y), z + 0.0001::DOUBLE * (0.2::DOUBLE + z * (x - 5.7::DOUBLE)) FROM s WHERE t < 1999) SELECT sid, t, {r('x', 'x')}, {r('y', 'y')}, {r('z', 'z')} FROM s CROSS JOIN range(2) g(sid)")(
    lambda spark, d: flat(generate.simulate_euler(spark.range(2).select(F.col("id").alias("sid")), "rossler", 2000), "x", "y", "z")
)


@query("test_battery", "SELECT sid, count(*) AS n FROM (VALUES ('rossler_chaotic'), ('rossler_sync'), ('lorenz'), ('henon'), ('chua')) g(sid) CROSS JOIN range(500) h(t) GROUP BY sid")
def _(spark, d):
    return generate.battery(spark, 500).groupBy("sid").agg(F.count(F.lit(1)).alias("n"))


@query("add_noise", build(f"SELECT sid, t, {r('v + ' + normal("('42|' || sid)", 't') + ' * sqrt(var_pop(v) OVER (PARTITION BY sid) / 2.0)', 'v')} FROM ev", "ev"))
def _(spark, d):
    return flat(generate.add_noise(sources.ev_user(spark, d), 2.0), "v")


# ------------------------------------------------------------------ spectra, filters, interpolation

#: Hann-windowed periodograms: no series here is longer than a segment of 256 samples.
_WELCH = {
    "c": _C,
    "wp": "SELECT sid, n, k, (power(sum(v * w * cos(2 * pi() * ((k * t) % n) / n)), 2) + power(sum(v * w * sin(2 * pi() * ((k * t) % n) / n)), 2)) / sum(w * w) * CASE WHEN 2 * k = n THEN 1 ELSE 2 END AS p FROM (SELECT *, 0.5 - 0.5 * cos(2 * pi() * t / n) AS w FROM c) CROSS JOIN range(1, 200) g(k) WHERE k <= n // 2 GROUP BY sid, n, k",
    "beta": "SELECT sid, -regr_slope(log10(p), log10(k::DOUBLE / n)) AS beta FROM wp WHERE p > 0 GROUP BY sid",
}


@query("noise_colour_welch", build(f"SELECT sid, {r('beta', 'beta')}, beta >= 0.5 AS pink FROM beta", "ev", "nz", **_WELCH))
def _(spark, d):
    return generate.is_pink(sources.ev_user(spark, d))


def _butterworth(cut: float) -> tuple[list[str], list[str]]:
    """SQL of the coefficients of a fourth-order high-pass, as two sections by the bilinear transform."""
    k = f"tan(pi() * {cut} / 2)"
    sections = []
    for angle in ("pi() / 8", "3 * pi() / 8"):
        d = f"2 * cos({angle})"
        norm = f"(1 + {d} * {k} + {k} * {k})"
        sections.append(([f"(1 / {norm})", f"(-2 / {norm})", f"(1 / {norm})"], ["1.0", f"(2 * ({k} * {k} - 1) / {norm})", f"((1 - {d} * {k} + {k} * {k}) / {norm})"]))
    times = lambda p, q: [" + ".join(f"{p[i]} * {q[j - i]}" for i in range(3) if 0 <= j - i < 3) for j in range(5)]
    return times(sections[0][0], sections[1][0]), times(sections[0][1], sections[1][1])


def _filter_sql() -> str:
    """Forward and backward over each series with its ends reflected by 15 samples; a state of four numbers
    goes along. Steady states for a constant input: sums of the later coefficients."""
    b, a = _butterworth(0.025)
    co = "SELECT " + ", ".join([*(f"{x} AS b{k}" for k, x in enumerate(b)), *(f"{x} AS a{k}" for k, x in enumerate(a) if k)])
    zi = [" + ".join(f"b{j}" for j in range(k + 1, 5)) for k in range(4)]
    ext = """SELECT sid, n, t + 15 AS p, v FROM e UNION ALL SELECT e.sid, e.n, 15 - e.t, 2 * f.v - e.v FROM e JOIN e f ON f.sid = e.sid AND f.t = 0 WHERE e.t BETWEEN 1 AND 15
        UNION ALL SELECT e.sid, e.n, 15 + 2 * (e.n - 1) - e.t, 2 * f.v - e.v FROM e JOIN e f ON f.sid = e.sid AND f.t = e.n - 1 WHERE e.t BETWEEN e.n - 16 AND e.n - 2"""

    def run(name: str, source: str) -> str:
        y = "(b0 * x.v + s.z0)"
        state = [f"{f's.z{k + 1} + ' if k < 3 else ''}b{k + 1} * x.v - a{k + 1} * {y}" for k in range(4)]
        start = ", ".join(f"({q}) * v" for q in zi)
        return f"""{name}(sid, p, y, z0, z1, z2, z3) AS (SELECT sid, -1::BIGINT, NULL::DOUBLE, {start} FROM {source} CROSS JOIN co WHERE p = 0
            UNION ALL SELECT s.sid, s.p + 1, {y}, {', '.join(state)} FROM {name} s JOIN {source} x ON x.sid = s.sid AND x.p = s.p + 1 CROSS JOIN co)"""

    base = build("", "ev", "nz", **_WELCH, e="SELECT sid, t, n, v FROM ev JOIN nz USING (sid)", co=co, ext=ext).rstrip()
    base = "WITH RECURSIVE" + base[4:]
    back = "rev AS (SELECT f.sid, n + 29 - f.p AS p, y AS v FROM fw f JOIN nz USING (sid) WHERE f.p >= 0)"
    done = "bw2 AS (SELECT b.sid, n + 29 - b.p - 15 AS t, y FROM bw b JOIN nz USING (sid) WHERE b.p >= 0)"
    return f"{base}, {run('fw', 'ext')}, {back}, {run('bw', 'rev')}, {done}, filtered AS (SELECT e.sid, e.t, e.v AS raw, beta, CASE WHEN beta >= 0.5 THEN y ELSE e.v END AS v, beta >= 0.5 AS done FROM e JOIN bw2 ON bw2.sid = e.sid AND bw2.t = e.t JOIN beta ON beta.sid = e.sid)"


@query("pink_filter", f"{_filter_sql()} SELECT sid, t, {r('v', 'v')}, {r('beta', 'beta')}, done AS filtered FROM filtered")
def _(spark, d):
    out = generate.pink_filter(sources.ev_user(spark, d))
    return out.select("sid", "t", F.col("x")[0].alias("v"), F.col("beta")[0].alias("beta"), F.col("filtered")[0].alias("filtered"))


@query("pink_filter_always", f"{_filter_sql().replace('beta >= 0.5', 'beta >= -9')} SELECT sid, t, round(v, 3) + 0.0 AS v FROM filtered")
def _(spark, d):
    return flat(generate.pink_filter(sources.ev_user(spark, d), threshold=-9.0), "v").withColumn("v", F.round("v", 3))


@query("filter_effect")
def _(spark, d):
    return plotdata.filter_effect(sources.ev_user(spark, d))


@query("tau_polynomial")
def _(spark, d):
    return generate.delay_polynomial(z(spark, d))


_PCHIP = {
    "kn": "SELECT sid, t, v, lag(t) OVER w AS t0, lead(t) OVER w AS t2, lag(v) OVER w AS v0, lead(v) OVER w AS v2 FROM ev WHERE t % 4 <> 1 WINDOW w AS (PARTITION BY sid ORDER BY t)",
    "dl": "SELECT *, t - t0 AS h0, t2 - t AS h1, (v - v0) / (t - t0) AS d0, (v2 - v) / (t2 - t) AS d1 FROM kn",
    # An end's own slope looks at its one interval and the next.
    "en": "SELECT *, CASE WHEN t0 IS NULL THEN h1 WHEN t2 IS NULL THEN h0 END AS g0, CASE WHEN t0 IS NULL THEN lead(h1) OVER w WHEN t2 IS NULL THEN lag(h0) OVER w END AS g1, CASE WHEN t0 IS NULL THEN d1 WHEN t2 IS NULL THEN d0 END AS e0, CASE WHEN t0 IS NULL THEN lead(d1) OVER w WHEN t2 IS NULL THEN lag(d0) OVER w END AS e1 FROM dl WINDOW w AS (PARTITION BY sid ORDER BY t)",
    "sl": "SELECT sid, t, v, t2, v2, CASE WHEN g0 IS NULL THEN CASE WHEN d0 * d1 > 0 THEN (3 * h0 + 3 * h1) / ((2 * h1 + h0) / d0 + (h1 + 2 * h0) / d1) ELSE 0 END WHEN e * e0 <= 0 THEN 0 WHEN e0 * e1 < 0 AND abs(e) > 3 * abs(e0) THEN 3 * e0 ELSE e END AS m FROM (SELECT *, ((2 * g0 + g1) * e0 - g0 * e1) / (g0 + g1) AS e FROM en)",
    "nx": "SELECT *, lead(m) OVER (PARTITION BY sid ORDER BY t) AS m2 FROM sl",
}


@query("fill_pchip", build(
    f"""SELECT ev.sid, ev.t, {r('CASE WHEN ev.t % 4 <> 1 THEN ev.v WHEN k.t2 IS NULL THEN k.v ELSE k.v * (1 + 2 * s) * power(1 - s, 2) + h * k.m * s * power(1 - s, 2) + k.v2 * s * s * (3 - 2 * s) + h * k.m2 * s * s * (s - 1) END', 'v')}
    FROM ev JOIN (SELECT *, t2 - t AS h, 1.0 / (t2 - t) AS s FROM nx) k ON k.sid = ev.sid AND k.t = CASE WHEN ev.t % 4 = 1 THEN ev.t - 1 ELSE ev.t END""", "ev", **_PCHIP))  # fmt: skip
def _(spark, d):
    gaps = sources.ev_user(spark, d).select("sid", "t", F.array(F.when(F.col("t") % 4 != 1, F.col("x")[0])).alias("x"))
    return flat(generate.fill_pchip(gaps), "v")


def _sensitivity(spark, d, measures, legacy=False, sizes=(15, 25), n_boot=100):
    out = None
    for m in measures:
        one = generate.window_sensitivity(z(spark, d), m, list(sizes), n_boot, legacy=legacy, tau=1, m=2, eps=0.5).withColumn("measure", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


@query("window_sensitivity")
def _(spark, d):
    return _sensitivity(spark, d, ("laminarity", "average_diagonal_length"))


@query("window_sensitivity_legacy")
def _(spark, d):
    return _sensitivity(spark, d, ("percent_lam", "avg_diag"), True)
