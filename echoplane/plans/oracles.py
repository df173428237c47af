"""Building blocks of the DuckDB statements: common table expressions over the driver's tables."""

from __future__ import annotations

#: name -> (body, names that it builds on)
CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "ev": ("SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS v FROM events", ()),
    "g0": ("SELECT user_id AS sid, ts, event_id, value AS x, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS us FROM events", ()),
    "ev2": ("SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) - 1 AS t, x, us / 1000000.0::DOUBLE AS y FROM g0 WHERE us IS NOT NULL", ("g0",)),
    "z": ("SELECT sid, t, (v - avg(v) OVER w) / (stddev_pop(v) OVER w + 1e-10) AS v FROM ev WINDOW w AS (PARTITION BY sid)", ("ev",)),
    "z2": ("SELECT sid, t, (x - avg(x) OVER w) / (stddev_pop(x) OVER w + 1e-10) AS x, (y - avg(y) OVER w) / (stddev_pop(y) OVER w + 1e-10) AS y FROM ev2 WINDOW w AS (PARTITION BY sid)", ("ev2",)),
    "emb2": ("SELECT * FROM (SELECT sid, t, v AS e0, lead(v) OVER (PARTITION BY sid ORDER BY t) AS e1 FROM z) WHERE e1 IS NOT NULL", ("z",)),
    "rp": ("SELECT a.sid, a.t AS i, b.t AS j FROM emb2 a JOIN emb2 b ON a.sid = b.sid AND sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1)) < 0.5", ("emb2",)),
    "emb22": ("SELECT * FROM (SELECT sid, t, x AS e0, y AS e1, lead(x) OVER w AS e2, lead(y) OVER w AS e3 FROM z2 WINDOW w AS (PARTITION BY sid ORDER BY t)) WHERE e2 IS NOT NULL", ("z2",)),
    "rp2d": ("SELECT a.sid, a.t AS i, b.t AS j FROM emb22 a JOIN emb22 b ON a.sid = b.sid AND sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1) + (a.e2 - b.e2) * (a.e2 - b.e2) + (a.e3 - b.e3) * (a.e3 - b.e3)) < 1.0", ("emb22",)),
    # Pairs of single samples, and the squared distances of their next q samples along each diagonal.
    "pz": ("SELECT a.sid, a.t AS i, b.t AS j, (a.v - b.v) * (a.v - b.v) AS dd FROM z a JOIN z b ON a.sid = b.sid AND a.t <> b.t", ("z",)),
    "nz": ("SELECT sid, count(*) AS n FROM ev GROUP BY sid", ("ev",)),
    "od": ("SELECT 0 AS sid, row_number() OVER (ORDER BY o_orderdate) - 1 AS t, v FROM (SELECT o_orderdate, sum(o_totalprice::DECIMAL(20, 4))::DOUBLE AS v FROM orders GROUP BY o_orderdate)", ()),
}


def plot_ctes(rp: str, emb: str) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Sizes, runs and histograms of a plot, as expressions named after it."""
    return {
        f"sz_{rp}": (f"SELECT sid, count(*) AS n FROM {emb} GROUP BY sid", (emb,)),
        f"dr_{rp}": (f"SELECT sid, k AS line, min(j) AS a, max(j) AS b FROM (SELECT sid, i - j AS k, j, j - row_number() OVER (PARTITION BY sid, i - j ORDER BY j) AS g FROM {rp} WHERE i > j) GROUP BY sid, k, g", (rp,)),
        f"vr_{rp}": (f"SELECT sid, j AS line, min(i) AS a, max(i) AS b FROM (SELECT sid, i, j, i - row_number() OVER (PARTITION BY sid, j ORDER BY i) AS g FROM {rp}) GROUP BY sid, j, g", (rp,)),
        f"hd_{rp}": (f"SELECT sid, b - a + 1 AS len, 2 * count(*) AS cnt FROM dr_{rp} GROUP BY 1, 2", (f"dr_{rp}",)),
        f"hv_{rp}": (f"SELECT sid, b - a + 1 AS len, count(*) AS cnt FROM vr_{rp} GROUP BY 1, 2", (f"vr_{rp}",)),
    }


CTE |= plot_ctes("rp", "emb2") | plot_ctes("rp2d", "emb22")


def build(select: str, *names: str, **extra: str) -> str:
    """WITH <what names and they build on> <extra> select."""
    order: list[str] = []

    def need(n: str) -> None:
        if n not in order:
            for m in CTE[n][1]:
                need(m)
            order.append(n)

    for n in names:
        need(n)
    parts = [f"{n} AS ({CTE[n][0]})" for n in order] + [f"{n} AS ({b})" for n, b in extra.items()]
    return f"WITH {', '.join(parts)} {select}" if parts else select


def line_stats(hist: str, keys: str, lmin: int = 2, guard: str = "1e-12") -> str:
    """SELECT of share, mean, entropy, mode and longest line of each histogram in hist (keys, len, cnt)."""
    return f"""
        SELECT {keys}, sum(CASE WHEN len >= {lmin} THEN len * cnt ELSE 0 END) / (sum(CASE WHEN len >= 1 THEN len * cnt ELSE 0 END) + {guard}) AS share,
            sum(CASE WHEN len >= {lmin} THEN len * cnt ELSE 0 END) / (sum(CASE WHEN len >= {lmin} THEN cnt ELSE 0 END) + {guard}) AS mean,
            coalesce(-sum(CASE WHEN len >= {lmin} THEN p * ln(p) END), 0.0) AS ent, coalesce(min(CASE WHEN len >= {lmin} AND cnt = top THEN len END), {lmin}) AS mode,
            coalesce(max(CASE WHEN len >= 1 THEN len END), 1) AS mx
        FROM (SELECT *, CASE WHEN len >= {lmin} THEN cnt::DOUBLE / sum(CASE WHEN len >= {lmin} THEN cnt END) OVER (PARTITION BY {keys}) END AS p,
            max(CASE WHEN len >= {lmin} THEN cnt END) OVER (PARTITION BY {keys}) AS top FROM {hist}) GROUP BY {keys}"""


def r(expression: str, name: str) -> str:
    return f"round(({expression})::DOUBLE, 6) + 0.0 AS {name}"


def measures(rp: str, keys: str = "sid") -> str:
    """The eleven measures of each plot."""
    return f"""
        SELECT s.sid, {r('coalesce(o.ones, 0)::DOUBLE / (s.n * s.n)', 'recurrence_rate')}, {r('coalesce(d.share, 0)', 'determinism')}, {r('coalesce(v.share, 0)', 'laminarity')},
            {r('coalesce(d.ent, 0)', 'diagonal_entropy')}, {r('coalesce(v.ent, 0)', 'vertical_entropy')}, {r('coalesce(d.mean, 0)', 'average_diagonal_length')}, {r('coalesce(v.mean, 0)', 'average_vertical_length')},
            coalesce(d.mx, 1)::BIGINT AS max_diagonal_length, coalesce(v.mx, 1)::BIGINT AS max_vertical_length, coalesce(d.mode, 2)::BIGINT AS diagonal_mode, coalesce(v.mode, 2)::BIGINT AS vertical_mode
        FROM sz_{rp} s LEFT JOIN (SELECT sid, count(*) AS ones FROM {rp} GROUP BY sid) o USING (sid) LEFT JOIN ({line_stats(f'hd_{rp}', 'sid')}) d USING (sid) LEFT JOIN ({line_stats(f'hv_{rp}', 'sid')}) v USING (sid)"""


#: Runs cut to windows of 20, every 7, by scanning the plot of each window again.
WINDOW, STEP = 20, 7
WINDOW_CTES = {
    "win": f"SELECT sid, unnest(range(0, n - {WINDOW} + 1, {STEP})) AS s FROM sz_rp WHERE n >= {WINDOW}",
    "wrp": f"SELECT w.sid, w.s, i, j FROM win w JOIN rp ON rp.sid = w.sid AND i BETWEEN s AND s + {WINDOW - 1} AND j BETWEEN s AND s + {WINDOW - 1}",
    "wd": "SELECT sid, s, len, 2 * count(*) AS cnt FROM (SELECT sid, s, count(*) AS len FROM (SELECT sid, s, i - j AS k, j - row_number() OVER (PARTITION BY sid, s, i - j ORDER BY j) AS g FROM wrp WHERE i > j) GROUP BY sid, s, k, g) GROUP BY sid, s, len",
    "wv": "SELECT sid, s, len, count(*) AS cnt FROM (SELECT sid, s, count(*) AS len FROM (SELECT sid, s, j, i - row_number() OVER (PARTITION BY sid, s, j ORDER BY i) AS g FROM wrp) GROUP BY sid, s, j, g) GROUP BY sid, s, len",
}
WINDOWED = f"""
    SELECT w.sid, w.s AS window_start, o.ones::DOUBLE / {WINDOW * WINDOW} AS recurrence_rate, coalesce(d.share, 0) AS determinism, coalesce(v.share, 0) AS laminarity, coalesce(d.ent, 0) AS diagonal_entropy, coalesce(v.ent, 0) AS vertical_entropy,
        coalesce(d.mean, 0) AS average_diagonal_length, coalesce(v.mean, 0) AS average_vertical_length, coalesce(d.mx, 1) AS max_diagonal_length, coalesce(v.mx, 1) AS max_vertical_length, coalesce(d.mode, 2) AS diagonal_mode, coalesce(v.mode, 2) AS vertical_mode
    FROM win w JOIN (SELECT sid, s, count(*) AS ones FROM wrp GROUP BY sid, s) o USING (sid, s) LEFT JOIN ({line_stats('wd', 'sid, s')}) d USING (sid, s) LEFT JOIN ({line_stats('wv', 'sid, s')}) v USING (sid, s)"""

#: Nearest neighbours in m dimensions (delay 1), and both distances, for m = 1 .. 8.
FNN = {
    **{f"d{m}": f"SELECT sid, i, j, CASE WHEN count(*) OVER w = {m} THEN sqrt(sum(dd) OVER w) END AS d FROM pz WINDOW w AS (PARTITION BY sid, i - j ORDER BY i ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)" for m in range(1, 10)},
    "nb": " UNION ALL ".join(
        f"SELECT {m} AS m, a.sid, a.i, a.d + 1e-12 AS dm, b.d AS dn FROM (SELECT * FROM d{m} WHERE d IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sid, i ORDER BY d, j) = 1) a JOIN d{m + 1} b ON a.sid = b.sid AND a.i = b.i AND a.j = b.j AND b.d IS NOT NULL"
        for m in range(1, 9)
    ),
    "sg": "SELECT sid, 3 * stddev_pop(v) AS sd FROM z GROUP BY sid",
    "rg": "SELECT k, 1 + k * (9.0::DOUBLE / 450) AS r FROM range(0, 451) x(k)",
    "fc": "SELECT m, sid, k, r, sum(CASE WHEN dm < sd / r AND dn / dm > r THEN 1 ELSE 0 END) / (sum(CASE WHEN dm < sd / r THEN 1 ELSE 0 END) + 1e-12) AS fnn FROM nb JOIN sg USING (sid) CROSS JOIN rg GROUP BY m, sid, k, r",
    "r0": "SELECT g.m, nz.sid, CASE WHEN nz.n > g.m + 1 THEN coalesce(min(CASE WHEN fnn < 0.001 THEN r END), -1.0) ELSE -1.0 END AS r0 FROM nz CROSS JOIN range(1, 9) g(m) LEFT JOIN fc ON fc.sid = nz.sid AND fc.m = g.m GROUP BY g.m, nz.sid, nz.n",
}

#: Lagged pairs for every lag that is tried, and mutual information of histograms.
MI = {
    "lm": "SELECT sid, n, greatest(1, least(100, n // 4) - 1) AS tmax FROM nz",
    "lg": "SELECT a.sid, (b.t - a.t) AS tau, a.v AS x, b.v AS y FROM z a JOIN lm USING (sid) JOIN z b ON a.sid = b.sid AND b.t > a.t AND b.t - a.t <= tmax",
    "lb": "SELECT sid, tau, n, B, CASE WHEN x1 > x0 THEN least(B - 1, floor((x - x0) / (x1 - x0) * B)) ELSE B // 2 END AS bx, CASE WHEN y1 > y0 THEN least(B - 1, floor((y - y0) / (y1 - y0) * B)) ELSE B // 2 END AS by_ FROM (SELECT *, least(15, greatest(3, floor(cbrt(n)))) AS B FROM (SELECT *, count(*) OVER w AS n, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM lg WINDOW w AS (PARTITION BY sid, tau)))",
    "hx": "SELECT sid, tau, sum(p * log2(p)) + (max(B) - count(*)) * max(q * log2(q)) AS h FROM (SELECT sid, tau, B, (count(*) + 1e-12) / (n + B * 1e-12) AS p, 1e-12 / (n + B * 1e-12) AS q FROM lb GROUP BY sid, tau, n, B, bx) GROUP BY sid, tau",
    "hy": "SELECT sid, tau, sum(p * log2(p)) + (max(B) - count(*)) * max(q * log2(q)) AS h FROM (SELECT sid, tau, B, (count(*) + 1e-12) / (n + B * 1e-12) AS p, 1e-12 / (n + B * 1e-12) AS q FROM lb GROUP BY sid, tau, n, B, by_) GROUP BY sid, tau",
    "hxy": "SELECT sid, tau, sum(p * log2(p)) + (max(B * B) - count(*)) * max(q * log2(q)) AS h FROM (SELECT sid, tau, B, (count(*) + 1e-12) / (n + B * B * 1e-12) AS p, 1e-12 / (n + B * B * 1e-12) AS q FROM lb GROUP BY sid, tau, n, B, bx, by_) GROUP BY sid, tau",
    "mi": "SELECT sid, tau, hxy.h - hx.h - hy.h AS mi FROM hxy JOIN hx USING (sid, tau) JOIN hy USING (sid, tau)",
    "ta": "SELECT lm.sid, coalesce(min(CASE WHEN mi > p THEN tau - 1 END), max(tmax)) AS tau FROM lm JOIN (SELECT *, lag(mi) OVER (PARTITION BY sid ORDER BY tau) AS p FROM mi) USING (sid) GROUP BY lm.sid",
}

#: Recurrence rate along the grid of radii 0, 0.01, ..., 10 for the embedding with delay 1 in 2 dimensions.
EPS = {
    "pd": "SELECT a.sid, floor(sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1)) / (10.0::DOUBLE / 1000)) + 1 AS k FROM emb2 a JOIN emb2 b ON a.sid = b.sid",
    "cv": "SELECT sid, k, sum(c) OVER (PARTITION BY sid ORDER BY k) / max(n * n) OVER (PARTITION BY sid) AS rate FROM (SELECT sid, k, count(*)::DOUBLE AS c FROM pd WHERE k <= 1000 GROUP BY sid, k) JOIN sz_rp USING (sid)",
    "gd": "SELECT sid, g.k, max(rate) AS rate FROM sz_rp CROSS JOIN range(1, 1001) g(k) JOIN cv USING (sid) WHERE cv.k <= g.k GROUP BY sid, g.k",
}
