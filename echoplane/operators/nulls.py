"""Surrogate nulls: whole data sets of surrogates go through the same analysis as the real one.

The kind of surrogate and the replicate are part of a series' key, so one distributed run of
the feature pipeline serves all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..ml import benchmarks
from . import features as ft
from . import generate, nonlinear, recurrence, short, stats

#: What each kind of surrogate says under the null hypothesis.
HYPOTHESES = {
    "FT": "linear autocorrelation is enough",
    "AAFT": "linear structure and the distribution of values are enough",
    "IAAFT": "refined linear structure and the distribution of values are enough",
    "IDFS": "digitally filtered shuffled structure is enough",
    "WIAAFT": "structure of wavelet scales is enough",
    "PPS": "periodic structure is enough",
}


def surrogate_features(series: DataFrame, kinds: tuple[str, ...], n: int, seed: int = 42, **kw) -> DataFrame:
    """(kind, rep, id, features...): the feature table of every surrogate data set."""
    if unknown := set(kinds) - set(kernels.SURROGATES):
        raise ValueError(f"Unknown surrogate kind: {sorted(unknown)}")
    made = None
    for kind in kinds:
        one = generate.surrogates(series, kind, n, seed)
        made = one if made is None else made.unionByName(one)
    keyed = made.select(F.to_json(F.struct(F.col("sid").cast("string").alias("s"), "kind", "rep")).alias("sid"), "t", "x")
    table = ft.feature_table(keyed, **kw)
    key = F.from_json(F.col("id"), "s string, kind string, rep int")
    return table.select(key["kind"].alias("kind"), key["rep"].alias("rep"), key["s"].alias("id"), *(c for c in table.columns if c != "id"))


def _vectors(table: DataFrame) -> DataFrame:
    """(kind, rep, id, [label], features) of surrogates' feature tables."""
    keyed = table.withColumn("id", F.struct("kind", "rep", "id")).drop("kind", "rep")
    return ft.feature_vectors(keyed)[0].select("id.kind", "id.rep", "id.id", *(c for c in ("label",) if c in table.columns), "features")


def _summary(real: DataFrame, null: DataFrame, keys: tuple[str, ...], side: str, correction: str, alpha: float) -> DataFrame:
    p = stats.rank_p_value(real, null, keys, side=side)
    d = stats.cohens_d(real, null, keys)
    n = null.groupBy(*keys).agg(F.avg("value").alias("null_mean"), F.stddev_pop("value").alias("null_std"))
    out = real.join(n, list(keys)).join(p, list(keys)).join(d.withColumnRenamed("d", "effect_size"), list(keys))
    if correction == "fdr_bh":
        return stats.benjamini_hochberg(out, alpha)
    if correction == "bonferroni":
        return stats.bonferroni(out, alpha)
    return out.withColumn("p_adjusted", F.col("p")).withColumn("significant", F.col("p") <= alpha)


def surrogate_null(series: DataFrame, labels: DataFrame, kinds: tuple[str, ...] = ("FT", "AAFT", "IAAFT"), n: int = 20, model: str = "knn", outer: int = 30, seed: int = 42, correction: str = "fdr_bh", alpha: float = 0.05, cv: dict | None = None, **kw) -> DataFrame:
    """(kind, null_hypothesis, metric, value, null_mean, null_std, p, effect_size, p_adjusted,
    significant): do real series classify better than their surrogates?"""
    cv = {"select": False, "inner_repeats": 2} | (cv or {})
    labels = labels.select(F.col("sid").cast("string").alias("id"), "label")
    own = ft.feature_table(series, **kw).withColumn("id", F.col("id").cast("string")).join(labels, "id")
    long = lambda df, *keys: df.groupBy(*keys).agg(*(F.avg(F.nanvl(c, F.lit(None))).alias(c) for c in ("accuracy", "roc_auc"))).unpivot(list(keys), ["accuracy", "roc_auc"], "metric", "value")
    real_cv = benchmarks.nested_cv(ft.feature_vectors(own)[0], model, outer, seed=seed, **cv)
    # Kind and replicate are keys of the work: all surrogate data sets are judged in one job.
    fake = _vectors(surrogate_features(series, kinds, n, seed, **kw).join(labels, "id"))
    null = benchmarks.nested_cv(fake, model, outer, seed=seed, keys=("kind", "rep"), **cv)
    real = long(real_cv, "model").drop("model").crossJoin(series.sparkSession.createDataFrame([(k, HYPOTHESES[k]) for k in kinds], "kind string, null_hypothesis string"))
    return _summary(real, long(null, "kind", "rep").drop("rep"), ("kind", "metric"), "greater", correction, alpha)


def surrogate_cluster_null(series: DataFrame, kinds: tuple[str, ...] = ("FT", "AAFT", "IAAFT"), n: int = 20, methods: tuple[str, ...] = ("kmeans",), ks: range = range(2, 7), seed: int = 42, correction: str = "fdr_bh", alpha: float = 0.05, **kw) -> DataFrame:
    """The same for the best clusterings (by silhouette) of each method; a low Davies-Bouldin index is
    the good end, so it is tested downwards."""

    def best(df: DataFrame, *keys: str) -> DataFrame:
        cols = ["silhouette", "calinski_harabasz", "davies_bouldin"]
        top = df.groupBy(*keys, "method").agg(F.max_by(F.struct(*cols), F.struct("silhouette", -F.col("n_clusters"))).alias("b"))
        return top.select(*keys, "method", "b.*").unpivot([*keys, "method"], cols, "metric", "value")

    own = ft.feature_table(series, **kw)
    real = best(benchmarks.cluster_sweep(ft.feature_vectors(own)[0], methods, ks, seed))
    null = benchmarks.cluster_sweep(_vectors(surrogate_features(series, kinds, n, seed, **kw)), methods, ks, seed, keys=("kind", "rep"))
    null = best(null, "kind", "rep").drop("rep")
    real = real.crossJoin(series.sparkSession.createDataFrame([(k, HYPOTHESES[k]) for k in kinds], "kind string, null_hypothesis string"))
    low = F.col("metric") == "davies_bouldin"
    keys = ("kind", "method", "metric")
    parts = [_summary(real.where(c), null.where(c), keys, side, correction, alpha) for c, side in ((low, "less"), (~low, "greater"))]
    return parts[0].unionByName(parts[1])


def validation(series: DataFrame, kinds: tuple[str, ...] = tuple(kernels.SURROGATES), n: int = 200, seed: int = 42) -> DataFrame:
    """(sid, kind, metric, p): two-sided rank p-values of the six statistics against surrogates."""
    metrics = ["lyapunov", "irreversibility", "entropy", "dimension", "nonlinearity", "predictability"]
    made, brief = None, short.fits(recurrence.longest(series))
    for kind in kinds:
        one = (generate.surrogate_rows if brief else generate.surrogates)(series, kind, n, seed)
        made = one if made is None else made.unionByName(one)
    if brief:  # what makes a surrogate also judges it: it is never sent
        null = short.statistics(made, "kind").withColumn("sid", F.col("sid").cast("string"))
    else:
        keyed = made.select(F.to_json(F.struct(F.col("sid").cast("string").alias("s"), "kind", "rep")).alias("sid"), "t", "x")
        null = nonlinear.all_metrics(keyed).withColumn("k", F.from_json("sid", "s string, kind string, rep int"))
        null = null.select(F.col("k.s").alias("sid"), F.col("k.kind").alias("kind"), *metrics)
    null = null.unpivot(["sid", "kind"], metrics, "metric", "null_v").where("null_v is not null")
    real = nonlinear.all_metrics(series).withColumn("sid", F.col("sid").cast("string")).unpivot(["sid"], metrics, "metric", "real_v").where("real_v is not null")
    j = real.join(null, ["sid", "metric"])
    up, down = (F.sum((F.col("null_v") >= F.col("real_v")).cast("int")) + 1), (F.sum((F.col("null_v") <= F.col("real_v")).cast("int")) + 1)
    return j.groupBy("sid", "kind", "metric").agg(F.least(F.lit(1.0), 2 * F.least(up, down) / (F.count(F.lit(1)) + 1)).alias("p"))
