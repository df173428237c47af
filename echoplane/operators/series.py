"""Sample-wise operators on series tables (sid, t, x)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def by_sid():
    return W.partitionBy("sid")


def in_time():
    return by_sid().orderBy("t")


def channels(df: DataFrame, dims: int) -> list[Column]:
    return [F.col("x")[k] for k in range(dims)]


def zscore(series: DataFrame, dims: int = 1, guard: float = 1e-10) -> DataFrame:
    """(x - mean) / (population deviation + guard), for each series and channel. Both are summed in order of
    time, so equal series give the same bits wherever their rows come from: bins and nearest neighbours are
    decided by last bits where values have few digits."""
    whole = series.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s"))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def ends(k: int) -> Column:
        def added(a: Column, r: Column) -> Column:
            v = r["x"][k]
            mean = a["mean"] + (v - a["mean"]) / (a["n"] + 1)
            return F.when(v.isNull(), a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + v).alias("sum"), mean.alias("mean"), (a["m2"] + (v - mean) * (v - a["mean"])).alias("m2")))

        return F.aggregate("s", zero, added, lambda a: F.struct(F.try_divide(a["sum"], a["n"]).alias("mean"), (F.sqrt(F.try_divide(a["m2"], a["n"])) + guard).alias("sd")))

    rows = whole.select("sid", *(ends(k).alias(f"_{k}") for k in range(dims)), "s").select("sid", *(f"_{k}" for k in range(dims)), F.inline("s"))
    return rows.select("sid", "t", F.array(*((c - F.col(f"_{k}")["mean"]) / F.col(f"_{k}")["sd"] for k, c in enumerate(channels(rows, dims)))).alias("x"))


def detrend(series: DataFrame, dims: int = 1) -> DataFrame:
    """x without its mean."""
    return series.select("sid", "t", F.array(*(c - F.avg(c).over(by_sid()) for c in channels(series, dims))).alias("x"))


def moving_average(series: DataFrame, window: int, dims: int = 1) -> DataFrame:
    """Means of window samples from each sample on; the tail without a whole window goes."""
    w = in_time().rowsBetween(0, window - 1)
    out = series.select("sid", "t", F.array(*(F.avg(c).over(w) for c in channels(series, dims))).alias("x"), F.count(F.lit(1)).over(w).alias("_n"))
    return out.where(F.col("_n") == window).drop("_n")


def decimate(series: DataFrame, step: int) -> DataFrame:
    """Every step-th sample, numbered anew."""
    return series.where(F.col("t") % step == 0).select("sid", (F.col("t") / step).cast("int").alias("t"), "x")


def polar(series: DataFrame, kind: str = "radius") -> DataFrame:
    """Two channels as radius, or as arctan(y / x): a quarter turn either way where x is 0, NaN where both are."""
    x, y = F.col("x")[0], F.col("x")[1]
    ratio = F.when(x != 0, F.try_divide(y, x)).when(x == 0, F.when(y == 0, math.nan).when(y > 0, math.inf).when(y < 0, -math.inf))
    value = F.sqrt(x * x + y * y) if kind == "radius" else F.atan(ratio)
    return series.select("sid", "t", F.array(value).alias("x"))


def wrap_phase(v: Column) -> Column:
    """A phase in (-pi, pi], up to rounding: remainders of 2 pi, with those over pi in size mapped back."""
    r = F.pmod(v, F.lit(2 * math.pi))
    return F.when(F.abs(r) > math.pi, r - 2 * math.pi * F.signum(r)).otherwise(r)


def fill_linear(series: DataFrame, dims: int = 1) -> DataFrame:
    """Missing values on the line between their neighbours; ends take the nearest value."""
    back, ahead = in_time().rowsBetween(W.unboundedPreceding, 0), in_time().rowsBetween(0, W.unboundedFollowing)
    out = []
    for c in channels(series, dims):
        v = F.when(~F.isnan(c), c)
        t = F.when(v.isNotNull(), F.col("t"))
        v0, v1, t0, t1 = (f.over(w) for f, w in ((F.last(v, True), back), (F.first(v, True), ahead), (F.last(t, True), back), (F.first(t, True), ahead)))
        out.append(F.coalesce(v, v0 + (v1 - v0) * (F.col("t") - t0) / (t1 - t0), v0, v1))
    return series.select("sid", "t", F.array(*out).alias("x"))


def order_parameter(series: DataFrame) -> DataFrame:
    """(sid, t, r): how far the phases in x agree at each time, from 0 to 1."""
    v = series.select("sid", "t", F.explode("x").alias("v"))
    return v.groupBy("sid", "t").agg(F.sqrt(F.pow(F.avg(F.cos("v")), 2) + F.pow(F.avg(F.sin("v")), 2)).alias("r"))


def sorted_with_indices(series: DataFrame) -> DataFrame:
    """(sid, rank, t, v): the first channel's values in order, and where each came from."""
    v = F.col("x")[0]
    w = by_sid().orderBy(v, "t")
    return series.select("sid", (F.row_number().over(w) - 1).alias("rank"), "t", v.alias("v"))


def is_integer_series(series: DataFrame) -> DataFrame:
    """(sid, is_int): 1 if all values are whole numbers."""
    return series.groupBy("sid").agg(F.min((F.col("x")[0] == F.floor(F.col("x")[0])).cast("int")).alias("is_int"))


def matched_ends(series: DataFrame, head: float = 0.01, tail: float = 0.1, points: int = 10) -> DataFrame:
    """Each series cut, after its mean is taken off, to the start in its first hundredth and the end in
    its last tenth whose next `points` samples differ least; ties take the earliest start and end."""
    z = detrend(series).select("sid", "t", F.col("x")[0].alias("v"))
    n = series.groupBy("sid").agg(F.count(F.lit(1)).alias("n"))
    near = z.withColumn("run", F.collect_list("v").over(in_time().rowsBetween(0, points - 1))).join(n, "sid")
    near = near.where(F.size("run") == points)
    starts = near.where(F.col("t") <= F.floor(F.col("n") * head)).select("sid", F.col("t").alias("a"), F.col("run").alias("r1"))
    ends = near.where(F.col("t") >= F.floor(F.col("n") * (1 - tail))).select("sid", F.col("t").alias("b"), F.col("run").alias("r2"))
    gap = F.aggregate(F.zip_with("r1", "r2", lambda p, q: F.abs(p - q)), F.lit(0.0), lambda s, d: s + d)
    best = starts.join(ends, "sid").where("a < b").groupBy("sid").agg(F.min_by(F.struct("a", "b"), F.struct(gap, "a", "b")).alias("c"))
    kept = z.join(best, "sid").where((F.col("t") >= F.col("c.a")) & (F.col("t") <= F.col("c.b")))
    return kept.select("sid", (F.col("t") - F.col("c.a")).cast("int").alias("t"), F.array("v").alias("x"))


def matrix_size_gib(d1: int, d2: int, d3: int, bytes_each: int = 8) -> float:
    """Memory of a dense d1 x d2 x d3 array."""
    return d1 * d2 * d3 * bytes_each / 2**30


def fits_memory(d1: int, d2: int, d3: int, limit_gib: float = 4, bytes_each: int = 8) -> bool:
    """Whether a dense d1 x d2 x d3 array takes less than limit_gib. Nothing here makes one; a caller that
    wants to may ask first."""
    return matrix_size_gib(d1, d2, d3, bytes_each) < limit_gib
