"""Nonlinear statistics of single-channel series, each as one row a series."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import embed, recurrence, short
from .information import lagged
from .series import by_sid, in_time

def _v():
    return F.col("x")[0]


def acf(series: DataFrame, max_lag: int = 100) -> DataFrame:
    """(sid, lag, acf): sums of x(t) x(t + lag) over the sum of squares, without centring, for lags
    1 .. max_lag - 1."""
    n = series.groupBy("sid").agg(F.least(F.lit(max_lag), F.count(F.lit(1)).cast("int")).alias("n"), F.sum(_v() * _v()).alias("s0"))
    pairs = lagged(series, n.select("sid", (F.col("n") - 1).alias("tau_max")))
    sums = pairs.groupBy("sid", F.col("tau").alias("lag")).agg(F.sum(F.col("x")[0] * F.col("y")[0]).alias("s"))
    return sums.join(n, "sid").select("sid", "lag", F.try_divide("s", "s0").alias("acf"))


def acf_delay(series: DataFrame, max_lag: int = 100) -> DataFrame:
    """(sid, tau): the first lag with negative autocorrelation, or one before the first rise, else 1."""
    prev = F.lag("acf").over(by_sid().orderBy("lag"))
    c = acf(series, max_lag).withColumn("p", prev)
    hit = F.when(F.col("acf") < 0, F.struct("lag", F.col("lag").alias("tau"))).when((F.col("lag") > 1) & (F.col("acf") > F.col("p")), F.struct("lag", (F.col("lag") - 1).alias("tau")))
    found = c.groupBy("sid").agg(F.min(hit).alias("h"))
    return series.select("sid").distinct().join(found, "sid", "left").select("sid", F.coalesce("h.tau", F.lit(1)).cast("int").alias("tau"))


def acf_zero(series: DataFrame) -> DataFrame:
    """(sid, tau): the first lag with negative autocorrelation of the centred series, else 1."""
    z = series.select("sid", "t", F.array(_v() - F.avg(_v()).over(by_sid())).alias("x"))
    n = z.groupBy("sid").agg((F.count(F.lit(1)) - 1).cast("int").alias("tau_max"))
    c = lagged(z, n).groupBy("sid", "tau").agg(F.sum(F.col("x")[0] * F.col("y")[0]).alias("s"))
    found = c.where("s < 0").groupBy("sid").agg(F.min("tau").alias("tau"))
    return series.select("sid").distinct().join(found, "sid", "left").select("sid", F.coalesce("tau", F.lit(1)).alias("tau"))


def lyapunov(series: DataFrame, dim: int = 3, tau: int = 1, points: int = 500, horizon: int = 20) -> DataFrame:
    """(sid, lyapunov): mean of ln(d_k / d_0) / k over the first points and their nearest neighbours;
    null for under 50 states."""
    if short.fits(recurrence.longest(series)):
        return short.lyapunov(series, dim, tau, points, horizon)
    e = embed.delay_embed(series, tau, dim)
    n = recurrence.sizes(e)
    nn = recurrence.nearest_neighbours(e, dim).join(n, "sid").where((F.col("n") >= 50) & (F.col("t") < F.least(F.col("n") - 1, F.lit(points))) & (F.col("d") > 0))
    last = F.least(F.lit(horizon), F.col("n") - F.greatest("t", "nn")) - 1
    ahead = nn.withColumn("last", last).where("last >= 1").withColumn("k", F.explode(F.sequence(F.lit(1), "last")))
    steps = ahead.select("sid", (F.col("t") + F.col("k")).alias("i"), (F.col("nn") + F.col("k")).alias("j"), "k", "d")
    a, b = e.select("sid", F.col("t").alias("i"), F.col("e").alias("ea")), e.select("sid", F.col("t").alias("j"), F.col("e").alias("eb"))
    dk = steps.join(a, ["sid", "i"]).join(b, ["sid", "j"]).select("sid", "k", "d", recurrence.distance(dim).alias("dk")).where("dk > 0")
    rate = dk.groupBy("sid").agg(F.avg(F.ln(F.col("dk") / F.col("d")) / F.col("k")).alias("lyapunov"))
    return n.join(rate, "sid", "left").select("sid", F.when(F.col("n") >= 50, F.col("lyapunov")).alias("lyapunov"))


def time_irreversibility(series: DataFrame) -> DataFrame:
    """(sid, irreversibility): root mean square, over lags up to min(n / 10, 20), of the difference of
    third moments forwards and backwards; null for under 10 samples."""
    z = series.select("sid", "t", F.array(_v() - F.avg(_v()).over(by_sid())).alias("x"))
    n = z.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    lags = n.select("sid", F.when(F.col("n") >= 10, F.least(F.floor(F.col("n") / 10), F.lit(20)) - 1).otherwise(0).cast("int").alias("tau_max"))
    x, y = F.col("x")[0], F.col("y")[0]
    diff = lagged(z, lags).groupBy("sid", "tau").agg((F.avg(y * x * x) - F.avg(x * y * y)).alias("d"))
    out = diff.groupBy("sid").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("irreversibility"))
    return n.join(out, "sid", "left").select("sid", "irreversibility")


def time_irreversibility_cubic(series: DataFrame) -> DataFrame:
    """(sid, irreversibility): the mean cube of increments, over n."""
    d = F.lead(_v()).over(in_time()) - _v()
    rows = series.select("sid", (d * d * d).alias("c"))
    return rows.groupBy("sid").agg((F.sum("c") / F.count(F.lit(1))).alias("irreversibility"))


def sample_entropy(series: DataFrame, m: int = 2, share: float = 0.2) -> DataFrame:
    """(sid, entropy): phi(m) - phi(m + 1), where phi is the mean log share of templates within share
    deviations (largest coordinate, a template matches itself)."""
    r = series.groupBy("sid").agg((share * F.stddev_pop(_v())).alias("r"))

    def phi(k: int, name: str) -> DataFrame:
        e = embed.delay_embed(series, 1, k)
        near = recurrence.pair_distances(e, k, metric="chebyshev").join(r, "sid").where("d <= r")
        ends = near.select("sid", F.explode(F.array("i", "j")).alias("t")).groupBy("sid", "t").agg(F.count(F.lit(1)).alias("c"))
        n = recurrence.sizes(e)
        counts = e.select("sid", "t").join(ends, ["sid", "t"], "left").join(n, "sid")
        return counts.groupBy("sid").agg(F.avg(F.ln((F.coalesce("c", F.lit(0)) + 1) / F.col("n").cast("double"))).alias(name))

    return phi(m, "a").join(phi(m + 1, "b"), "sid").select("sid", (F.col("a") - F.col("b")).alias("entropy"))


def correlation_dimension(series: DataFrame, dim: int = 5, top: int = 200, stride: int = 5, n_radii: int = 20) -> DataFrame:
    """(sid, dimension): slope of log correlation on log radius over n_radii radii from a hundredth of
    the deviation to it; every stride-th state i of the first top, with i + 1, i + 1 + stride, ...
    Null for under 100 samples or 50 states."""
    base = series.groupBy("sid").agg(F.count(F.lit(1)).alias("n_all"), F.stddev_pop(_v()).alias("sd"))
    e = embed.delay_embed_by(series, acf_delay(series).withColumn("m", F.lit(dim)))
    n = recurrence.sizes(e).join(base, "sid").where("n >= 50 and n_all >= 100")
    first = e.join(n.select("sid"), "sid", "left_semi").where(F.col("t") < top)
    a = first.where(F.col("t") % stride == 0).select("sid", F.col("t").alias("i"), F.col("e").alias("ea"))
    b = first.select("sid", F.col("t").alias("j"), F.col("e").alias("eb"))
    d = a.join(b, "sid").where((F.col("j") > F.col("i")) & ((F.col("j") - F.col("i")) % stride == 1)).select("sid", recurrence.distance(dim).alias("d"))
    # A distance counts from the first radius above it on.
    exponents = [-2 + 2 * k / (n_radii - 1) for k in range(n_radii)]
    per = d.join(base, "sid").groupBy("sid", "sd").agg(F.count(F.lit(1)).alias("pairs"), *(F.sum((F.col("d") < F.lit(10.0**x) * F.col("sd")).cast("int")).alias(f"c{k}") for k, x in enumerate(exponents)))
    points = per.select("sid", F.explode(F.array(*(F.struct((F.lit(x * math.log(10)) + F.ln("sd")).alias("x"), F.ln(F.greatest(F.col(f"c{k}") / F.col("pairs"), F.lit(1e-10))).alias("y")) for k, x in enumerate(exponents)))).alias("p"))
    slope = points.groupBy("sid").agg(F.regr_slope("p.y", "p.x").alias("dimension"))
    return base.join(slope, "sid", "left").select("sid", "dimension")


def correlation_sum(embedded: DataFrame, radii: list[float], window: int = 10, metric: str = "chebyshev", width: int | None = None) -> DataFrame:
    """(sid, r, c): the share of pairs more than window apart that are nearer than r."""
    d = recurrence.pair_distances(embedded, width, metric=metric).where(F.col("i") - F.col("j") > window)
    counts = d.groupBy("sid").agg(F.count(F.lit(1)).alias("pairs"), *(F.sum((F.col("d") < r).cast("int")).alias(f"c{k}") for k, r in enumerate(radii)))
    return counts.select("sid", F.explode(F.array(*(F.struct(F.lit(float(r)).alias("r"), (F.col(f"c{k}") / F.col("pairs")).alias("c")) for k, r in enumerate(radii)))).alias("p")).select("sid", "p.r", "p.c")


def nonlinearity_index(series: DataFrame) -> DataFrame:
    """(sid, nonlinearity): size of the population skewness of increments."""
    d = series.select("sid", (F.lead(_v()).over(in_time()) - _v()).alias("d")).where("d is not null")
    c = d.select("sid", (F.col("d") - F.avg("d").over(by_sid())).alias("c"))
    return c.groupBy("sid").agg(F.abs(F.try_divide(F.avg(F.col("c") * F.col("c") * F.col("c")), F.pow(F.avg(F.col("c") * F.col("c")), 1.5))).alias("nonlinearity"))


def predictability(series: DataFrame) -> DataFrame:
    """(sid, predictability): mean error of going on in a straight line, over the deviation; null for
    under 20 samples."""
    guess = 2 * F.lag(_v(), 1).over(in_time()) - F.lag(_v(), 2).over(in_time())
    rows = series.select("sid", "t", _v().alias("v"), F.abs(_v() - guess).alias("e"), F.count(F.lit(1)).over(by_sid()).alias("n"))
    inside = (F.col("t") >= 10) & (F.col("t") <= F.col("n") - 2)
    return rows.groupBy("sid").agg(F.when(F.max("n") >= 20, F.try_divide(F.avg(F.when(inside, F.col("e"))), F.stddev_pop("v"))).alias("predictability"))


def chi2_stationarity(series: DataFrame, bins: int = 10) -> DataFrame:
    """(sid, chi2): how far the first half's histogram is from the whole series' share."""
    rows = series.select("sid", "t", _v().alias("v"), F.min(_v()).over(by_sid()).alias("lo"), F.max(_v()).over(by_sid()).alias("hi"), F.count(F.lit(1)).over(by_sid()).alias("n"))
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")) * bins))).otherwise(bins // 2)
    half = F.ceil(F.col("n") / 2)
    cells = rows.groupBy("sid", "n", b.alias("b")).agg(F.count(F.lit(1)).alias("q"), F.sum((F.col("t") < half).cast("int")).alias("h"))
    expected = F.ceil(F.col("n") / 2) / F.col("n") * F.col("q") + 1e-9
    # An empty cell has expectation 1e-9 and no observations: it adds 1e-9.
    term = F.sum((F.col("h") - expected) * (F.col("h") - expected) / expected) + (bins - F.count(F.lit(1))) * 1e-9
    return cells.groupBy("sid").agg(term.alias("chi2"))


def periodogram(series: DataFrame) -> DataFrame:
    """(sid, k, f, power): |DFT|^2 / n of the centred series at the positive frequencies k / n."""
    z = series.select("sid", "t", (_v() - F.avg(_v()).over(by_sid())).alias("v"), F.count(F.lit(1)).over(by_sid()).alias("n"))
    ks = z.where("n >= 2").withColumn("k", F.explode(F.sequence(F.lit(1), F.floor(F.col("n") / 2).cast("int"))))
    angle = 2 * math.pi * ((F.col("k").cast("long") * F.col("t")) % F.col("n")) / F.col("n")
    sums = ks.groupBy("sid", "n", "k").agg(F.sum(F.col("v") * F.cos(angle)).alias("c"), F.sum(F.col("v") * F.sin(angle)).alias("s"))
    return sums.select("sid", "k", (F.col("k") / F.col("n")).alias("f"), ((F.col("c") * F.col("c") + F.col("s") * F.col("s")) / F.col("n")).alias("power"))


def noise_colour(series: DataFrame) -> DataFrame:
    """(sid, beta): minus the slope of log power on log frequency of the periodogram."""
    p = periodogram(series).where("power > 0")
    return p.groupBy("sid").agg((-F.regr_slope(F.log10("power"), F.log10("f"))).alias("beta"))


def henon(n: int, a: float = 1.4, b: float = 0.3, x0: float = 0.1, y0: float = 0.1):
    """SQL for the Henon map's first n points, as an array of (x, y) in order."""
    step = f"array_append(acc, struct(1D - {a}D * acc[i - 1].x * acc[i - 1].x + acc[i - 1].y as x, {b}D * acc[i - 1].x as y))"
    return f"aggregate(sequence(1, {n - 1}), array(struct({x0}D as x, {y0}D as y)), (acc, i) -> {step})"


def all_metrics(series: DataFrame) -> DataFrame:
    """The six statistics of each series, one row each."""
    if short.fits(recurrence.longest(series)):
        return short.statistics(short.rows(series))
    out = lyapunov(series)
    for df in (time_irreversibility(series), sample_entropy(series), correlation_dimension(series), nonlinearity_index(series), predictability(series)):
        out = out.join(df, "sid", "left")
    return out
