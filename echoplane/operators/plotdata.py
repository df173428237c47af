"""Tables that hold what a figure shows; drawing is left to the reader's tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RqaConfig
from . import generate, information, nonlinear, parameters, stats


def mi_curve(series: DataFrame, dims: int = 1) -> DataFrame:
    """(sid, tau, mi, is_opt)."""
    curve = information.mi_curve(series, dims)
    best = information.first_rise(curve, series).select("sid", F.col("tau").alias("best"))
    return curve.join(best, "sid").select("sid", "tau", "mi", (F.col("tau") == F.col("best")).alias("is_opt"))


def fnn_curve(series: DataFrame, tau: int, top: int = 7, r: float = 10.0, dims: int = 1) -> DataFrame:
    """(sid, m, fnn) at one threshold."""
    out = None
    for m in range(1, top + 1):
        one = parameters.fnn_ratio(series, tau, m, r, dims).withColumn("m", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out.select("sid", "m", "fnn")


def threshold_curves(series: DataFrame, tau: int, top: int = 7, cfg: RqaConfig = RqaConfig(), dims: int = 1) -> DataFrame:
    """(sid, m, r, fnn) along the grid of thresholds."""
    step, out = (cfg.rmax - cfg.rmin) / (cfg.rdiv - 1), None
    for m in range(1, top + 1):
        one = parameters.fnn_curve(series, tau, m, cfg, dims).select("sid", F.lit(m).alias("m"), (cfg.rmin + F.col("r_index") * step).alias("r"), "fnn")
        out = one if out is None else out.union(one)
    return out


def minimum_distribution(curves: DataFrame) -> DataFrame:
    """(m, low, high): 2.5 and 97.5 % quantiles over series of each curve's least value."""
    least = curves.groupBy("sid", "m").agg(F.min("fnn").alias("f"))
    return least.groupBy("m").agg(F.percentile("f", 0.025).alias("low"), F.percentile("f", 0.975).alias("high"))


def spectrum(series: DataFrame) -> DataFrame:
    """(sid, f, psd)."""
    return nonlinear.periodogram(series).select("sid", "f", F.col("power").alias("psd"))


def filter_effect(series: DataFrame, **kw) -> DataFrame:
    """(sid, t, before, after, beta, filtered) of the first channel."""
    after = generate.pink_filter(series, **kw)
    both = series.select("sid", "t", F.col("x")[0].alias("before")).join(after, ["sid", "t"])
    return both.select("sid", "t", "before", F.col("x")[0].alias("after"), F.col("beta")[0].alias("beta"), F.col("filtered")[0].alias("filtered"))


def top_importances(importance: DataFrame, n: int = 15) -> DataFrame:
    return importance.orderBy(F.desc("importance_mean"), "feature").limit(n)


def confusion_matrix(pred: DataFrame, normalise: bool = False) -> DataFrame:
    """(y, yhat, n), or shares of each true class."""
    c = stats.confusion(pred)
    return c.withColumn("n", F.col("n") / F.sum("n").over(W.partitionBy("y"))) if normalise else c


def principal_components(vectors: DataFrame, k: int = 2) -> DataFrame:
    """(id, pc array) of standardised features (id, features)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select("id", array_to_vector("features").alias("v"))
    scaled = StandardScaler(withMean=True, inputCol="v", outputCol="s").fit(v).transform(v)
    return PCA(k=k, inputCol="s", outputCol="p").fit(scaled).transform(scaled).select("id", vector_to_array("p").alias("pc"))
