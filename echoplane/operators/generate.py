"""Operators that make series: surrogates, filters, simulated systems, bootstraps. Each is a numpy
kernel run per series in the tasks; seeds follow from keys, so a task that is run again repeats
its result."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as k
from ..functions.hashrng import HashRng
from ..plans.materialise import dealt
from . import information, windows


#: Replicates that are made of a series in a row.
BLOCK = 25


def seed_of(*key) -> HashRng:
    return HashRng(*key)


def _by_channel(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf.sort_values("t")["x"].to_list()).astype(float)


def surrogates(series: DataFrame, kind: str, n: int = 200, seed: int = 42, legacy: bool = False) -> DataFrame:
    """(sid, kind, rep, t, x): n surrogates of each series."""
    whole = surrogate_rows(series, kind, n, seed, legacy)
    return whole.select("sid", "kind", "rep", F.expr("inline(transform(sequence(0, n - 1), i -> struct(i as t, slice(xs, i * cast(size(xs) / n as int) + 1, cast(size(xs) / n as int)) as x)))"))


def surrogate_rows(series: DataFrame, kind: str, n: int = 200, seed: int = 42, legacy: bool = False) -> DataFrame:
    """(sid, kind, rep, n, xs): a row a surrogate, as `short.rows` has series."""
    table = k.LEGACY_SURROGATES if legacy else k.SURROGATES
    if kind not in table:
        raise KeyError(f"Unknown surrogate kind: {kind}")
    make, sid_type = table[kind], series.schema["sid"].dataType.simpleString()

    def together(pdf):
        found = {}
        for r in pdf.itertuples(index=False):
            x = np.stack(r.xs).astype(float)
            for rep in range(r.block * BLOCK, min(n, (r.block + 1) * BLOCK)):
                found.setdefault(x.shape, []).append((r.sid, rep, x))
                if len(found[x.shape]) * x.size >= 1 << 15:
                    yield alike(found.pop(x.shape))
        yield from map(alike, found.values())

    def alike(own):
        x, rngs = np.stack([x for *_, x in own]), [seed_of(seed, kind, sid, rep) for sid, rep, _ in own]
        out = np.stack([k.alternate_all(kind, x[:, :, c], rngs) for c in range(x.shape[2])], axis=2)
        return pd.DataFrame({"sid": [sid for sid, *_ in own], "kind": kind, "rep": [rep for _, rep, _ in own], "n": x.shape[1], "xs": list(out.reshape(len(own), -1))})

    def run(batches):
        for pdf in batches:
            made, samples = [], 0
            if kind in k.TOGETHER:
                yield from together(pdf)
                continue
            for r in pdf.itertuples(index=False):
                x = np.stack(r.xs).astype(float)
                for rep in range(r.block * BLOCK, min(n, (r.block + 1) * BLOCK)):
                    rng = seed_of(seed, kind, r.sid, rep)
                    out = np.stack([make(x[:, c], rng) for c in range(x.shape[1])], axis=1)
                    made.append((r.sid, kind, rep, len(out), out.ravel()))
                    samples += out.size
                    if samples >= 1 << 17:
                        yield pd.DataFrame(made, columns=["sid", "kind", "rep", "n", "xs"])
                        made, samples = [], 0
            if made:
                yield pd.DataFrame(made, columns=["sid", "kind", "rep", "n", "xs"])

    # A series travels once for each BLOCK of its replicates, as one row.
    whole = series.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("xs"))
    work = whole.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(max(0, (n - 1) // BLOCK)))))
    work = dealt(work, "sid", "block") if n > 1 else work
    return work.select("sid", "block", "xs").mapInPandas(run, f"sid {sid_type}, kind string, rep int, n int, xs array<double>")


def pink_filter(series: DataFrame, threshold: float = 0.5, cutoff: float = 0.05, order: int = 4) -> DataFrame:
    """(sid, t, x, beta, filtered): each channel high-passed where it is pink noise."""
    sid_type = series.schema["sid"].dataType.simpleString()

    def run(key, pdf):
        x = _by_channel(pdf)
        parts = [k.pink_filter(x[:, c], threshold, cutoff, order) for c in range(x.shape[1])]
        return pd.DataFrame({"sid": key[0], "t": np.arange(len(x)), "x": list(np.stack([p[0] for p in parts], axis=1)), "beta": [[p[1] for p in parts]] * len(x), "filtered": [[p[2] for p in parts]] * len(x)})

    return series.groupBy("sid").applyInPandas(run, f"sid {sid_type}, t int, x array<double>, beta array<double>, filtered array<boolean>")


def noise_colour_welch(series: DataFrame) -> DataFrame:
    """(sid, beta) from Welch's spectrum."""
    sid_type = series.schema["sid"].dataType.simpleString()

    def run(key, pdf):
        return pd.DataFrame({"sid": [key[0]], "beta": [k.spectral_slope(_by_channel(pdf)[:, 0])]})

    return series.groupBy("sid").applyInPandas(run, f"sid {sid_type}, beta double")


def is_pink(series: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(sid, beta, pink)."""
    return noise_colour_welch(series).withColumn("pink", F.col("beta") >= threshold)


def fill_pchip(series: DataFrame) -> DataFrame:
    """Missing values of the first channel by monotone cubics; ends take the nearest value."""
    sid_type = series.schema["sid"].dataType.simpleString()

    def run(key, pdf):
        pdf = pdf.sort_values("t")
        v = np.array([x[0] if x is not None and x[0] is not None else np.nan for x in pdf["x"]], float)
        t = np.arange(len(v), dtype=float)
        ok = ~np.isnan(v)
        if ok.sum() == 1:
            v[:] = v[ok][0]
        elif ok.sum() > 1:
            inside = ~ok & (t > t[ok][0]) & (t < t[ok][-1])
            v[inside] = k.pchip(t[ok], v[ok], t[inside])
            v[t < t[ok][0]], v[t > t[ok][-1]] = v[ok][0], v[ok][-1]
        return pd.DataFrame({"sid": key[0], "t": pdf["t"], "x": [[a] for a in v]})

    return series.groupBy("sid").applyInPandas(run, f"sid {sid_type}, t int, x array<double>")


def add_noise(series: DataFrame, snr: float, seed: int = 42) -> DataFrame:
    """Gaussian noise of 1 / snr of each channel's variance."""
    sid_type = series.schema["sid"].dataType.simpleString()

    def run(key, pdf):
        x = _by_channel(pdf)
        y = x + seed_of(seed, *key).normal(size=x.shape) * np.sqrt(x.var(axis=0) / snr)
        return pd.DataFrame({"sid": key[0], "t": np.arange(len(x)), "x": list(y)})

    return series.groupBy("sid").applyInPandas(run, f"sid {sid_type}, t int, x array<double>")


#: Defaults of each system. Fixed values.
DEFAULTS = {name: dict(p) for name, (_, p) in k.FLOWS.items()} | {"henon": {"a": 1.4, "b": 0.3}, "kuramoto": {"n_osc": 10, "K": 1.0, "omega_sd": 1.0, "tmax": 100.0}, "sine": {}, "white_noise": {}}
#: The parameter that decides each system's regime, its threshold, and the regimes' names.
REGIMES = {"rossler": ("c", 4.2, "periodic", "chaotic"), "lorenz": ("rho", 24.74, "fixed_point", "chaotic"), "henon": ("a", 1.06, "periodic", "chaotic"), "chua": ("alpha", 8.8, "periodic", "chaotic"), "kuramoto": ("K", None, "incoherent", "synchronized")}


def critical_coupling(omega_sd: float) -> float:
    return omega_sd * math.sqrt(8 / math.pi)


def regime_threshold(system: str, omega_sd: float = 1.0) -> float | None:
    if system not in REGIMES:
        return None
    return critical_coupling(omega_sd) if system == "kuramoto" else REGIMES[system][1]


def regime_table(spark: SparkSession) -> DataFrame:
    """(system, param, threshold, below, above)."""
    return spark.createDataFrame([(s, p, regime_threshold(s), lo, hi) for s, (p, _, lo, hi) in REGIMES.items()], "system string, param string, threshold double, below string, above string")


def regime_values(spark: SparkSession, distribution: str, n: int, side: str, threshold: float, seed: int = 42, **dist) -> DataFrame:
    """(k, value): n draws of a parameter, moved to one side of threshold where they cross it."""
    if distribution not in ("uniform", "normal", "fixed"):
        raise ValueError(f"Unknown distribution '{distribution}'")
    if side not in ("below", "above"):
        raise ValueError("side must be 'below' or 'above'")
    draw = {"uniform": lambda: F.rand(seed) * (dist["high"] - dist["low"]) + dist["low"], "normal": lambda: F.randn(seed) * dist["sd"] + dist["mean"], "fixed": lambda: F.lit(float(dist["value"]))}[distribution]()
    margin = max(abs(threshold) * 1e-3, 1e-6)
    kept = F.least(draw, F.lit(threshold - margin)) if side == "below" else F.greatest(draw, F.lit(threshold + margin))
    return spark.range(n).select(F.col("id").alias("k"), kept.alias("value"))


def simulate(params: DataFrame, system: str, n: int = 2000, tmax: int | None = None, dt: float = 0.01, noise_sd: float = 0.0, seed: int = 42) -> DataFrame:
    """(sid, t, x) for each row of params (sid and any of the system's parameters as columns). The
    rows of a task are integrated together."""
    if system not in DEFAULTS:
        raise ValueError(f"Unknown system '{system}'")
    defaults, sid_type = DEFAULTS[system], params.schema["sid"].dataType.simpleString()
    given = [c for c in params.columns if c != "sid"]
    if unknown := set(given) - set(defaults):
        raise ValueError(f"Unknown parameters of {system}: {sorted(unknown)}")
    top = tmax or 10_000

    def run(batches):
        for pdf in batches:
            p = {c: pdf[c].to_numpy(float) if c in pdf else np.full(len(pdf), float(v)) for c, v in defaults.items()}
            if system in k.FLOWS:
                out = k.flow(system, n, top, dt, p, np.tile(np.array(k.STARTS[system]), (len(pdf), 1)))
            elif system == "henon":
                out = k.henon(n, p["a"], p["b"], (np.full(len(pdf), 0.1), np.full(len(pdf), 0.1)))
            elif system == "kuramoto":
                one = lambda i, s: k.kuramoto(n, int(p["n_osc"][i]), p["K"][i], p["omega_sd"][i], p["tmax"][i], seed_of(seed, s))
                out = None if pdf.empty else [one(i, s) for i, s in enumerate(pdf["sid"])]
            else:
                wave = np.sin(np.linspace(0, 8 * np.pi, n))
                out = np.stack([wave if system == "sine" else seed_of(seed, s).standard_normal(n) for s in pdf["sid"]], axis=1)[:, :, None] if len(pdf) else None
            for i, s in enumerate(pdf["sid"]):
                x = out[i] if isinstance(out, list) else out[:, i]
                if noise_sd > 0:
                    x = x + noise_sd * seed_of(seed, "noise", s).standard_normal(x.shape)
                yield pd.DataFrame({"sid": s, "t": np.arange(len(x)), "x": list(x)})

    return params.select("sid", *given).mapInPandas(run, f"sid {sid_type}, t int, x array<double>")


def battery(spark: SparkSession, n: int = 2000) -> DataFrame:
    """(sid, t, x): first channels of five systems, named by their setting."""
    out = None
    for name, system, p in (("rossler_chaotic", "rossler", {"a": 0.1}), ("rossler_sync", "rossler", {"a": 0.3}), ("lorenz", "lorenz", {}), ("henon", "henon", {}), ("chua", "chua", {})):
        row = spark.createDataFrame([{"sid": name, **p}])
        one = simulate(row, system, n).select("sid", "t", F.slice("x", 1, 1).alias("x"))
        out = one if out is None else out.union(one)
    return out


def delay_polynomial(series: DataFrame, dims: int = 1, legacy: bool = False) -> DataFrame:
    """(sid, tau): the first minimum of a polynomial, of cross-validated degree, through the curve of
    mutual information. The older form takes lags from 2 to n - 1, 15 bins and pseudo-counts of 1e-9."""
    if legacy:
        lags = series.groupBy("sid").agg((F.count(F.lit(1)) - 1).cast("int").alias("tau_max"))
        curve = information.mi_curve(series, dims, lags=lags, bins=15, pseudo=1e-9).where("tau >= 2")
    else:
        curve = information.mi_curve(series, dims)
    sid_type = series.schema["sid"].dataType.simpleString()

    def run(key, pdf):
        pdf = pdf.sort_values("tau")
        x, y = pdf["tau"].to_numpy(float), pdf["mi"].to_numpy(float)
        if len(x) < (10 if legacy else 3):
            return pd.DataFrame({"sid": [key[0]], "tau": [1]})
        fit = np.poly1d(np.polyfit(x, y, k.polynomial_degree(x, y, legacy)))
        return pd.DataFrame({"sid": [key[0]], "tau": [int(x[k.first_minimum(fit(x), legacy)])]})

    return curve.groupBy("sid").applyInPandas(run, f"sid {sid_type}, tau int")


#: measure -> (kind of line, statistic)
SENSITIVITY = {"determinism": ("diag", "percent"), "laminarity": ("vert", "percent"), "average_diagonal_length": ("diag", "average"), "average_vertical_length": ("vert", "average")}


#: The same for the older names.
LEGACY_SENSITIVITY = {"percent_det": ("diag", "percent"), "percent_lam": ("vert", "percent"), "avg_diag": ("diag", "legacy average"), "avg_vert": ("vert", "legacy average")}


def window_sensitivity(series: DataFrame, measure: str, sizes: list[int] | None = None, n_boot: int = 1000, seed: int = 42, legacy: bool = False, **kw) -> DataFrame:
    """(sid, window_size, ci_width): how uncertain a measure is in windows of each size. The older form
    counts the main diagonal and zeros as lines too, and takes sizes from 20 on, 10 apart, below
    each plot's side, if none are given."""
    table = LEGACY_SENSITIVITY if legacy else SENSITIVITY
    if measure not in table:
        raise ValueError(f"Unknown measure: {measure}")
    kind, statistic = table[measure]
    if sizes is None:
        longest = series.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        sizes = list(range(20, longest - (kw.get("m", 1) - 1) * kw.get("tau", 1), 10))
    sid_type, pooled = series.schema["sid"].dataType.simpleString(), None
    for w in sizes:
        one = windows.pooled_histogram(series, w, kind, legacy=legacy, **kw).withColumn("window_size", F.lit(w))
        pooled = one if pooled is None else pooled.unionByName(one)

    def run(key, pdf):
        p = np.zeros(int(key[1]) + 1)
        p[pdf["len"].to_numpy(int)] = pdf["p"]
        return pd.DataFrame({"sid": [key[0]], "window_size": [key[1]], "ci_width": [k.bootstrap_width(p, int(pdf["n_bar"].iloc[0]), statistic, n_boot, seed_of(seed, *key))]})

    out = f"sid {sid_type}, window_size int, ci_width double"
    if pooled is None:
        return series.sparkSession.createDataFrame([], out)
    return dealt(pooled, "sid", "window_size").groupBy("sid", "window_size").applyInPandas(run, out)


def window_sensitivity_groups(series: DataFrame, measure: str, n_boot: int = 1000, **kw) -> DataFrame:
    """The older table over a collection: window_size, ci_width and the group, the part of sid before "-"."""
    out = window_sensitivity(series, measure, None, n_boot, legacy=True, **kw)
    return out.withColumn("group", F.substring_index(F.col("sid").cast("string"), "-", 1))


def simulate_euler(params: DataFrame, system: str = "rossler", steps: int = 10_000, dt: float = 1e-4) -> DataFrame:
    """(sid, t, x) of a flow by explicit Euler steps, for each row of params as `simulate` takes them."""
    defaults, sid_type = DEFAULTS[system], params.schema["sid"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            p = {c: pdf[c].to_numpy(float) if c in pdf else np.full(len(pdf), float(v)) for c, v in defaults.items()}
            out = k.euler(system, steps, dt, p, np.tile(np.array(k.STARTS[system]), (len(pdf), 1)))
            for i, s in enumerate(pdf["sid"]):
                yield pd.DataFrame({"sid": s, "t": np.arange(steps), "x": list(out[:, i])})

    return params.mapInPandas(run, f"sid {sid_type}, t int, x array<double>")
