"""Mutual information of delayed series: histograms, and nearest neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import recurrence, short
from .series import in_time


def bin_counts(series: DataFrame, method: str = "default") -> DataFrame:
    """(sid, bins) for the first channel by the named rule. Spark's percentile interpolates as the
    rules expect; Doane's uses population skewness."""
    v = F.col("x")[0]
    one = series.select("sid", v.alias("v"))
    n = F.count(F.lit(1))
    if method == "FD":
        iqr = F.percentile("v", 0.75) - F.percentile("v", 0.25) + 1e-9
        b = F.ceil(F.pow(n.cast("double"), F.lit(1 / (3 + 1e-9))) * (F.max("v") - F.min("v")) / (2 * iqr))
    elif method == "sqrt":
        b = F.ceil(F.sqrt(n))
    elif method == "rice":
        b = 2 * F.ceil(F.cbrt(n))
    elif method == "sturges":
        b = 1 + F.ceil(F.ln(n))
    elif method == "doanes":
        mean = F.avg("v").over(W.partitionBy("sid"))
        c = one.select("sid", (F.col("v") - mean).alias("c"))
        g1 = F.avg(F.pow("c", 3)) / F.pow(F.avg(F.col("c") * F.col("c")), 1.5)
        sigma = F.sqrt(6 * (n - 2) / ((n + 1) * (n + 3)).cast("double"))
        k = 1 + F.log2(n.cast("double")) + F.log2(1 + F.abs(g1) / sigma)
        return c.groupBy("sid").agg(F.ceil(2 * k / 3).cast("int").alias("bins"))
    elif method == "default":
        b = F.lit(15)
    else:
        raise ValueError(f"Unknown bin rule: {method}")
    return one.groupBy("sid").agg(b.cast("int").alias("bins"))


def _by_lag(series: DataFrame, lags: DataFrame | range | list[int]) -> DataFrame:
    """(sid, s, tau): each series as one array, a row for each of its lags."""
    whole = series.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("s"))
    if isinstance(lags, DataFrame):
        whole = whole.join(lags, "sid").withColumn("tau", F.explode(F.when(F.col("tau_max") >= 1, F.sequence(F.lit(1), "tau_max")).otherwise(F.array().cast("array<int>"))))
    else:
        whole = whole.withColumn("tau", F.explode(F.array(*map(F.lit, lags))))
    return whole.where("size(s) > tau").select("sid", "s", "tau")


def lagged(series: DataFrame, lags: DataFrame | range | list[int]) -> DataFrame:
    """(sid, tau, x, y): samples and what follows tau later, for every lag at once. lags may be a
    table (sid, tau_max). The series travels as one array, so this needs no join of samples."""
    return _by_lag(series, lags).select("sid", "tau", F.expr("inline(transform(sequence(0, size(s) - tau - 1), i -> struct(s[i] as x, s[i + tau] as y)))"))


def lagged_by_join(series: DataFrame, lags: list[int]) -> DataFrame:
    """The same for series too long for one array: samples meet those tau later by (sid, t)."""
    a = series.withColumn("tau", F.explode(F.array(*map(F.lit, lags)))).select("sid", "tau", (F.col("t") + F.col("tau")).alias("t"), "x")
    return a.join(series.select("sid", "t", F.col("x").alias("y")), ["sid", "t"]).select("sid", "tau", "x", "y")


def _bucket(v: Column, lo: Column, hi: Column, bins: Column) -> Column:
    """Equal bins with a closed top; a constant column falls into one bin."""
    return F.when(hi > lo, F.least(bins - 1, F.floor((v - lo) / F.when(hi > lo, hi - lo) * bins))).otherwise(F.floor(bins / 2)).cast("int")


def _n_bins(n: Column, bins: int | None) -> Column:
    return F.lit(bins) if bins else F.least(F.lit(15), F.greatest(F.lit(3), F.floor(F.cbrt(n)).cast("int")))


def _information(cells: DataFrame, dims: int, keys: tuple[str, ...], pseudo: float) -> DataFrame:
    """(keys, mi) from cells (keys, n, B, bx, by, c): counts of joint bins, and with them both axes' in one
    pass. Every cell has pseudo added; the empty ones, of which there may be very many, are
    summed in closed form."""
    nothing = F.lit(None).cast("array<int>")
    views = F.array(*(F.struct(F.lit(k).alias("view"), a.alias("cx"), b.alias("cy")) for k, (a, b) in enumerate(((F.col("bx"), F.col("by")), (F.col("bx"), nothing), (nothing, F.col("by"))))))
    seen = cells.select(*keys, "n", "B", "c", F.explode(views).alias("v")).groupBy(*keys, "n", "B", "v.view", "v.cx", "v.cy").agg(F.sum("c").alias("c"))
    all_cells = F.pow(F.col("B").cast("double"), F.when(F.col("view") == 0, 2 * dims).otherwise(dims))
    total = F.col("n") + all_cells * pseudo
    p, p0 = (F.col("c") + pseudo) / total, F.lit(pseudo) / total
    # All cells of a view as if they were empty; those seen give their own term instead.
    full = lambda v: F.sum(F.when(F.col("view") == v, p * F.log2(p) - p0 * F.log2(p0))) + F.first(F.when(F.col("view") == v, all_cells * p0 * F.log2(p0)), ignorenulls=True)
    return seen.groupBy(*keys).agg((full(0) - full(1) - full(2)).alias("mi"))


def mutual_information(pairs: DataFrame, dims: int = 1, keys: tuple[str, ...] = ("sid", "tau"), bins: int | None = None, pseudo: float = 1e-12) -> DataFrame:
    """(keys, mi): information (bits) that x and y share, by histograms of min(15, max(3, cbrt n))
    equal bins an axis, or of bins."""
    ends = [f(F.col(c)[k]).alias(f"{f.__name__}_{c}{k}") for c in "xy" for k in range(dims) for f in (F.min, F.max)]
    bounds = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *ends)
    rows = pairs.join(bounds, list(keys)).withColumn("B", _n_bins(F.col("n"), bins))
    axis = lambda c: F.array(*(_bucket(F.col(c)[k], F.col(f"min_{c}{k}"), F.col(f"max_{c}{k}"), F.col("B")) for k in range(dims)))
    cells = rows.groupBy(*keys, "n", "B", axis("x").alias("bx"), axis("y").alias("by")).agg(F.count(F.lit(1)).alias("c"))
    return _information(cells, dims, keys, pseudo)


def mutual_information_avg(pairs: DataFrame, dims: int, keys: tuple[str, ...] = ("sid", "tau"), **kw) -> DataFrame:
    """(keys, mi): the mean of the channels' own information, each with its own bins."""
    long = pairs.select(*keys, F.explode(F.array(*(F.struct(F.lit(k).alias("ch"), F.array(F.col("x")[k]).alias("x"), F.array(F.col("y")[k]).alias("y")) for k in range(dims)))).alias("p"))
    flat = long.select(*keys, "p.ch", "p.x", "p.y")
    return mutual_information(flat, 1, (*keys, "ch"), **kw).groupBy(*keys).agg(F.avg("mi").alias("mi"))


def _lag_cells(rows: DataFrame, dims: int, keys: tuple[str, ...], bins: int | None) -> DataFrame:
    """Counts of joint bins of each row (keys, s, tau): bounds and bins are worked out in the row, so no
    window over the lagged pairs, and no exchange of them, is needed."""
    n = F.expr("size(s) - tau")
    own = rows.select(*keys, "s", "tau", n.alias("n"), _n_bins(n, bins).alias("B"))
    part = {"x": "slice(s, 1, n)", "y": "slice(s, tau + 1, n)"}
    ends = [F.expr(f"array_{f}(transform({part[c]}, v -> v[{k}]))").alias(f"{f}_{c}{k}") for c in "xy" for k in range(dims) for f in ("min", "max")]
    own = own.select("*", *ends)
    v = lambda c, k: f"s[i{' + tau' if c == 'y' else ''}][{k}]"
    one = lambda c, k: f"cast(case when max_{c}{k} > min_{c}{k} then least(B - 1, floor(({v(c, k)} - min_{c}{k}) / (max_{c}{k} - min_{c}{k}) * B)) else floor(B / 2) end as int)"
    axis = lambda c: "array(" + ", ".join(one(c, k) for k in range(dims)) + ")"
    cells = own.select(*keys, "n", "B", F.expr(f"inline(transform(sequence(0, n - 1), i -> struct({axis('x')} as bx, {axis('y')} as by)))"))
    return cells.groupBy(*keys, "n", "B", "bx", "by").agg(F.count(F.lit(1)).alias("c"))


def max_lag(series: DataFrame) -> DataFrame:
    """(sid, tau_max): lags that are tried, min(100, n / 4) - 1 and at least 1."""
    return series.groupBy("sid").agg(F.greatest(F.lit(1), F.least(F.lit(100), F.floor(F.count(F.lit(1)) / 4).cast("int")) - 1).alias("tau_max"))


def mi_curve(series: DataFrame, dims: int = 1, method: str = "histdd", lags: DataFrame | list[int] | None = None, bins: int | None = None, pseudo: float = 1e-12) -> DataFrame:
    """(sid, tau, mi) for all lags."""
    if method not in ("histdd", "avg"):
        raise ValueError(f"Unknown method of mutual information: {method}")
    rows = _by_lag(series, max_lag(series) if lags is None else lags)
    if method == "avg" and dims > 1:
        per = rows.select("sid", "tau", F.explode(F.array(*(F.struct(F.lit(k).alias("ch"), F.expr(f"transform(s, v -> array(v[{k}]))").alias("s")) for k in range(dims)))).alias("p")).select("sid", "tau", "p.ch", "p.s")
        keys = ("sid", "tau", "ch")
        return _information(_lag_cells(per.select("sid", "ch", "s", "tau"), 1, keys, bins), 1, keys, pseudo).groupBy("sid", "tau").agg(F.avg("mi").alias("mi"))
    return _information(_lag_cells(rows, dims, ("sid", "tau"), bins), dims, ("sid", "tau"), pseudo)


def first_rise(curve: DataFrame, series: DataFrame) -> DataFrame:
    """(sid, tau): the lag before information first rises; without a rise the last lag tried."""
    prev = F.lag("mi").over(W.partitionBy("sid").orderBy("tau"))
    rise = curve.withColumn("p", prev).groupBy("sid").agg(F.min(F.when(F.col("mi") > F.col("p"), F.col("tau") - 1)).alias("tau"))
    last = max_lag(series)
    return last.join(rise, "sid", "left").select("sid", F.coalesce("tau", "tau_max").cast("int").alias("tau"))


def delay(series: DataFrame, dims: int = 1, method: str = "histdd") -> DataFrame:
    """(sid, tau) by the first rise of mutual information."""
    return first_rise(mi_curve(series, dims, method), series)


def delay_legacy(series: DataFrame, dims: int = 1) -> DataFrame:
    """(sid, tau) with lags up to n - 1, 15 bins and pseudo-counts of 1e-9; n - 2 without a rise."""
    n = series.groupBy("sid").agg((F.count(F.lit(1)) - 1).cast("int").alias("tau_max"))
    curve = mi_curve(series, dims, lags=n, bins=15, pseudo=1e-9)
    prev = F.lag("mi").over(W.partitionBy("sid").orderBy("tau"))
    rise = curve.withColumn("p", prev).groupBy("sid").agg(F.min(F.when(F.col("mi") > F.col("p"), F.col("tau") - 1)).alias("tau"))
    return n.join(rise, "sid", "left").select("sid", F.coalesce("tau", F.col("tau_max") - 1).cast("int").alias("tau"))


def first_minimum(curve: DataFrame, order: str, value: str, key: str = "sid", legacy: bool = False) -> DataFrame:
    """(key, first_min): the place of the first local minimum, or of the lowest value. Ends count
    where they are lower than their one neighbour; in the older form the last one does not."""
    w = W.partitionBy(key).orderBy(order)
    near = curve.select(key, (F.row_number().over(w) - 1).alias("at"), F.col(value).alias("v"), F.lag(value).over(w).alias("p"), F.lead(value).over(w).alias("q"))
    end = F.col("q").isNull() & (F.lit(not legacy) | F.col("p").isNull())
    low = ((F.col("p").isNull()) | (F.col("v") < F.col("p"))) & (end | (F.col("v") < F.col("q")))
    return near.groupBy(key).agg(F.coalesce(F.min(F.when(low, F.col("at"))), F.min_by("at", F.struct("v", "at"))).cast("int").alias("first_min"))


def ksg(pairs: DataFrame, k: int = 3, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(keys, mi): Kraskov's first estimator, in nats, over pairs (keys, t, x, y): for each point
    the distance to its k-th neighbour (larger of the two spaces' distances), and how many points
    are nearer than that in each space."""
    a, b = pairs.select(*keys, F.col("t").alias("i"), F.col("x").alias("xa"), F.col("y").alias("ya")), pairs.select(*keys, F.col("t").alias("j"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    norm = lambda p, q: F.sqrt(F.aggregate(F.zip_with(p, q, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v))
    d = a.join(b, list(keys)).where("i <> j").select(*keys, "i", norm("xa", "xb").alias("dx"), norm("ya", "yb").alias("dy"))
    w = W.partitionBy(*keys, "i")
    near = d.withColumn("r", F.row_number().over(w.orderBy(F.greatest("dx", "dy"))))
    radius = F.max(F.when(F.col("r") == k, F.greatest("dx", "dy"))).over(w)
    counts = near.withColumn("e", radius).groupBy(*keys, "i").agg(F.sum((F.col("dx") < F.col("e")).cast("int")).alias("nx"), F.sum((F.col("dy") < F.col("e")).cast("int")).alias("ny"))
    # digamma of a whole number n: -gamma + 1 + 1/2 + ... + 1/(n - 1)
    gamma = 0.5772156649015329
    psi = lambda c: F.aggregate(F.when(c > 1, F.sequence(F.lit(1), (c - 1).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(-gamma), lambda s, v: s + F.lit(1.0) / v)
    mean = counts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(psi(F.col("nx") + 1)).alias("px"), F.avg(psi(F.col("ny") + 1)).alias("py"))
    return mean.select(*keys, (psi(F.col("n")) + psi(F.lit(k)) - F.col("px") - F.col("py")).alias("mi"))


def ksg_lagged(series: DataFrame, tau: int, k: int = 5) -> DataFrame:
    """(sid, mi) of each series and itself tau later."""
    if short.fits(recurrence.longest(series)):
        return short.ksg_lagged(series, tau, k)
    pairs = series.select("sid", "t", "x", F.lead("x", tau).over(in_time()).alias("y")).where("y is not null")
    return ksg(pairs, k)
