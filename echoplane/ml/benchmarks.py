"""Benchmarks over a feature table (id, label, features): each fold, permutation or resample is a row
of a work table, and the rows are dealt to tasks. The feature table has a row a series, so it is
sent to the tasks, behind a check of its size."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashrng import HashRng
from ..functions.special import wilcoxon_p
from ..operators import stats
from ..plans.materialise import dealt
from . import models as m

#: Rows of a feature table that tasks may be sent; larger ones need a model that trains distributed.
MAX_ROWS = 200_000
METRICS = ("accuracy", "balanced_accuracy", "f1_macro", "roc_auc")


class Table:
    """A feature table as arrays."""

    def __init__(self, features: DataFrame, groups: bool = False, need_labels: bool = True):
        n = features.count()
        if n > MAX_ROWS:
            raise ValueError(f"{n} rows; benchmarks take {MAX_ROWS} at most")
        pdf = features.orderBy("id").toPandas()
        self.x = np.stack(pdf["features"].to_list()).astype(float) if n else np.zeros((0, 0))
        self.ids = pdf["id"].to_numpy()
        self.y, self.classes = None, []
        if "label" in pdf and need_labels:
            if len(pdf["label"].dropna()) != n:
                raise ValueError("labels length must match the number of rows")
            self.classes, self.y = np.unique(pdf["label"].astype(str).to_numpy(), return_inverse=True)
            if len(self.classes) < 2:
                raise ValueError("at least two classes are needed")
        self.groups = pdf["grp"].to_numpy() if groups else None


def _work(features: DataFrame, rows: list[tuple], schema: str, run, out: str) -> DataFrame:
    spark = features.sparkSession
    work = spark.createDataFrame(rows, schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))
    return work.mapInPandas(lambda it: (pd.DataFrame(run(r), columns=[c.split()[0] for c in out.split(", ")]) for pdf in it for r in pdf.itertuples(index=False)), out)


def _by_group(features: DataFrame, keys: tuple[str, ...], run, out: str) -> DataFrame:
    """run(x, y) on the rows of each group of keys, in the group's task; its rows get the keys in front."""
    kinds = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, *(c.split()[0] for c in out.split(", "))]

    def one(key, pdf):
        if len(pdf) > MAX_ROWS:
            raise ValueError(f"{len(pdf)} rows in {key}; benchmarks take {MAX_ROWS} at most")
        pdf = pdf.sort_values("id")
        y = np.unique(pdf["label"].astype(str).to_numpy(), return_inverse=True)[1] if "label" in pdf else None
        return pd.DataFrame([(*key, *r) for r in run(np.stack(pdf["features"].to_list()).astype(float), y)], columns=names)

    return dealt(features, *keys).groupBy(*keys).applyInPandas(one, f"{kinds}, {out}")


_CV = "model string, iteration int, accuracy double, balanced_accuracy double, f1_macro double, roc_auc double, selected array<int>, params string"


def _cv_round(x, y, g, model: str, iteration: int, seed: int, test_share: float, inner_splits: int, inner_repeats: int, select: bool, tune: bool, max_features: int | None) -> tuple:
    """One outer split: selects features, tunes and fits on its training part alone."""
    k = max(2, round(1 / test_share))
    fold = m.stratified(y, min(k, len(np.unique(g))) if g is not None else k, HashRng(seed, iteration), g)
    train, test = fold != 0, fold == 0
    inner = [m.stratified(y[train], inner_splits, HashRng(seed, iteration, j), g[train] if g is not None else None) for j in range(inner_repeats)]
    params = {}
    cols = m.select_features(model, params, x[train], y[train], inner, max_features) if select else list(range(x.shape[1]))
    if tune:
        params = max(m.grid(model), key=lambda p: m.cv_accuracy(model, p, x[train][:, cols], y[train], inner))
    classes, yt = np.unique(y[train], return_inverse=True)
    p = np.zeros((test.sum(), len(np.unique(y))))
    p[:, classes] = m.make(model, **params).fit(x[train][:, cols], yt, np.random.default_rng([seed, iteration])).predict_proba(x[test][:, cols])
    s = m.scores(y[test], p)
    return (model, iteration, *(s[k] for k in METRICS), cols, json.dumps(params))


def nested_cv(features: DataFrame, model: str | tuple[str, ...] = "knn", outer: int = 100, test_share: float = 1 / 3, inner_splits: int = 2, inner_repeats: int = 10, select: bool = True, tune: bool = False, max_features: int | None = None, seed: int = 42, groups: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """(model, iteration, four scores, selected, params): each outer split selects features, tunes and
    fits on its training part alone. Several models share the outer splits. With keys, each group
    of rows is a data set of its own, judged in its own task, and the keys come first."""
    names = (model,) if isinstance(model, str) else tuple(model)
    for n in names:
        m.make(n)
    how = dict(seed=seed, test_share=test_share, inner_splits=inner_splits, inner_repeats=inner_repeats, select=select, tune=tune, max_features=max_features)
    if keys:
        return _by_group(features, keys, lambda x, y: [_cv_round(x, y, None, n, i, **how) for n in names for i in range(outer)], _CV)
    t = Table(features, groups)
    held = features.sparkSession.sparkContext.broadcast((t.x, t.y, t.groups))
    return _work(features, [(n, i) for i in range(outer) for n in names], "model string, iteration int", lambda r: [_cv_round(*held.value, r.model, r.iteration, **how)], _CV)


def feature_frequency(cv: DataFrame, names: list[str]) -> DataFrame:
    """(feature, frequency): share of outer splits that chose each feature."""
    n = cv.agg(F.count(F.lit(1)).alias("n"))
    chosen = cv.select(F.explode("selected").alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    named = F.array(*map(F.lit, names))
    return chosen.crossJoin(F.broadcast(n)).select(named[F.col("k")].alias("feature"), (F.col("c") / F.col("n")).alias("frequency"))


def quick_benchmark(features: DataFrame, names: tuple[str, ...] = tuple(m.MODELS), folds: int = 5, seed: int = 42) -> DataFrame:
    """(model, mean and deviation of three scores) by stratified folds, best first."""
    for n in names:
        m.make(n)
    t = Table(features)
    held = features.sparkSession.sparkContext.broadcast((t.x, t.y))

    def run(r):
        x, y = held.value
        fold = m.stratified(y, folds, HashRng(seed))
        train, test = fold != r.fold, fold == r.fold
        if not test.any() or len(np.unique(y[train])) < len(np.unique(y)):
            return []
        s = m.scores(y[test], m.make(r.model).fit(x[train], y[train], np.random.default_rng([seed, r.fold])).predict_proba(x[test]))
        return [(r.model, r.place, *(s[k] for k in METRICS))]

    rows = _work(features, [(n, i, f) for i, n in enumerate(names) for f in range(folds)], "model string, place int, fold int", run, "model string, place int, accuracy double, balanced_accuracy double, f1_macro double, roc_auc double")
    sums = [f(F.nanvl(c, F.lit(None))).alias(f"{c}_{n}") for c in ("accuracy", "f1_macro", "roc_auc") for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return rows.groupBy("model", "place").agg(*sums).orderBy(F.desc("accuracy_mean"), F.desc("f1_macro_mean"), "place").drop("place")


def comparison(cvs: DataFrame) -> DataFrame:
    """(model, means and deviations of the scores), best first, of several models' `nested_cv` rows."""
    sums = [f(F.nanvl(c, F.lit(None))).alias(f"{c}_{n}") for c in METRICS for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return cvs.groupBy("model").agg(*sums).orderBy(F.desc("accuracy_mean"), "model")


def pairwise_tests(cvs: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(model_a, model_b, statistic, p_value, effect_size, p_adjusted, significant) by signed ranks of
    the models' accuracies, corrected by Benjamini and Hochberg."""
    a, b = cvs.select(F.col("model").alias("model_a"), "iteration", F.col("accuracy").alias("a")), cvs.select(F.col("model").alias("model_b"), "iteration", F.col("accuracy").alias("b"))
    pairs = a.join(b, "iteration").where("model_a < model_b")

    def test(key, pdf):
        d = (pdf["a"] - pdf["b"]).to_numpy()
        w, p = wilcoxon_p(d)
        n = len(d)
        effect = 1 - 2 * w / (n * (n + 1) / 2) if np.any(d) else 0.0
        return pd.DataFrame({"model_a": [key[0]], "model_b": [key[1]], "statistic": [w if np.any(d) else math.nan], "p_value": [p], "effect_size": [effect]})

    tested = pairs.groupBy("model_a", "model_b").applyInPandas(test, "model_a string, model_b string, statistic double, p_value double, effect_size double")
    return stats.benjamini_hochberg(tested, alpha, value="p_value")


def integrated_benchmark(features: DataFrame, names: tuple[str, ...] = tuple(m.MODELS), outer: int = 50, alpha: float = 0.05, seed: int = 42, **kw) -> dict:
    """Nested cross-validation of all models on the same outer splits: "scores" (its rows),
    "comparison", "tests" (pairwise) and "best", the leading model fitted to all rows."""
    cvs = nested_cv(features, names, outer, inner_splits=2, inner_repeats=kw.get("inner_repeats", 5), select=kw.get("select", True), tune=kw.get("tune", True), max_features=kw.get("max_features"), seed=seed, groups=kw.get("groups", False))
    cvs = cvs.persist()
    table = comparison(cvs)
    t, leader = Table(features), table.first().model
    best = m.make(leader).fit(t.x, t.y, np.random.default_rng(seed))
    return {"scores": cvs, "comparison": table, "tests": pairwise_tests(cvs, alpha), "best": best, "model": leader}


def permutation_null(features: DataFrame, model: str = "knn", n: int = 100, seed: int = 42) -> DataFrame:
    """(permutation, accuracy, roc_auc) with labels in random order."""
    t = Table(features)
    held = features.sparkSession.sparkContext.broadcast((t.x, t.y))

    def run(r):
        x, y = held.value
        rng = HashRng(seed, r.permutation)
        y = rng.permutation(y)
        k = max(2, min(5, int(np.bincount(y).min())))
        fold, out = m.stratified(y, k, rng), []
        for f in range(k):
            train, test = fold != f, fold == f
            if len(np.unique(y[train])) == len(np.unique(y)) and test.any():
                out.append(m.scores(y[test], m.make(model).fit(x[train], y[train], np.random.default_rng([seed, r.permutation])).predict_proba(x[test])))
        return [(r.permutation, float(np.mean([s["accuracy"] for s in out])), float(np.nanmean([s["roc_auc"] for s in out])))]

    return _work(features, [(i,) for i in range(n)], "permutation int", run, "permutation int, accuracy double, roc_auc double")


def permutation_importance(features: DataFrame, names: list[str], model: str = "rf", repeats: int = 10, seed: int = 42) -> DataFrame:
    """(feature, importance_mean, importance_std): accuracy lost when a feature's values are shuffled."""
    t = Table(features)
    fitted = m.make(model).fit(t.x, t.y, np.random.default_rng(seed))
    base = float(np.mean(fitted.predict_proba(t.x).argmax(axis=1) == t.y))
    held = features.sparkSession.sparkContext.broadcast((t.x, t.y, fitted))

    def run(r):
        x, y, model_ = held.value
        x = x.copy()
        x[:, r.k] = HashRng(seed, r.k, r.repeat).permutation(x[:, r.k])
        return [(names[r.k], base - float(np.mean(model_.predict_proba(x).argmax(axis=1) == y)))]

    rows = _work(features, [(k, i) for k in range(len(names)) for i in range(repeats)], "k int, repeat int", run, "feature string, loss double")
    return rows.groupBy("feature").agg(F.avg("loss").alias("importance_mean"), F.stddev_pop("loss").alias("importance_std")).orderBy(F.desc("importance_mean"), "feature")


_SWEEP = "method string, n_clusters int, silhouette double, calinski_harabasz double, davies_bouldin double, adjusted_rand double, labels array<int>"


def _scaled(x: np.ndarray) -> np.ndarray:
    sd = x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(sd == 0, 1, sd)


def _sweep_round(x, y, method: str, k: int, seed: int) -> tuple:
    x = _scaled(x)
    label, _ = m.CLUSTERS[method](x, k, np.random.default_rng([seed, k]))
    i = m.cluster_indices(x, label)
    return (method, k, i["silhouette"], i["calinski_harabasz"], i["davies_bouldin"], m.adjusted_rand(label, y) if y is not None else None, label.tolist())


def cluster_sweep(features: DataFrame, methods: tuple[str, ...] = tuple(m.CLUSTERS), ks: range = range(2, 7), seed: int = 42, keys: tuple[str, ...] = ()) -> DataFrame:
    """(method, n_clusters, silhouette, calinski_harabasz, davies_bouldin, adjusted_rand, labels). With
    keys, each group of rows is a data set of its own, and the keys come first."""
    if unknown := set(methods) - set(m.CLUSTERS):
        raise ValueError(f"Unknown method: {sorted(unknown)}")
    if keys:
        return _by_group(features, keys, lambda x, y: [_sweep_round(x, y, a, k, seed) for a in methods for k in ks if 2 <= k < len(x)], _SWEEP)
    try:
        t = Table(features)
    except ValueError:
        t = Table(features, need_labels=False)
    held = features.sparkSession.sparkContext.broadcast((t.x, t.y))
    rows = [(a, k) for a in methods for k in ks if 2 <= k < len(t.x)]
    return _work(features, rows, "method string, k int", lambda r: [_sweep_round(*held.value, r.method, r.k, seed)], _SWEEP)


def cluster_stability(features: DataFrame, method: str = "kmeans", k: int = 2, n_boot: int = 100, share: float = 0.8, seed: int = 42, scale: bool = True) -> DataFrame:
    """(mean_ari, std_ari, n_pairs): how alike the labels of all rows are, by models of subsamples."""
    if method == "agglomerative":
        raise ValueError("stability needs a method that can predict: kmeans or gmm")
    if method not in m.CLUSTERS:
        raise ValueError(f"Unknown method: {method}")
    t = Table(features, need_labels=False)
    held = features.sparkSession.sparkContext.broadcast(_scaled(t.x) if scale else t.x)

    def run(r):
        x, rng = held.value, np.random.default_rng([seed, r.b])
        rows = rng.choice(len(x), min(len(x), max(k + 1, int(share * len(x)))), replace=False)
        _, predict = m.CLUSTERS[method](x[rows], k, rng)
        return [(r.b, predict(x).tolist())]

    labels = _work(features, [(b,) for b in range(n_boot)], "b int", run, "b int, labels array<int>")
    a, b = labels.toDF("a", "la"), labels.toDF("b", "lb")
    picked = a.join(b, F.col("a") < F.col("b")).orderBy(F.xxhash64(F.lit(seed), "a", "b")).limit(500)

    @F.pandas_udf("double")
    def ari(p: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([m.adjusted_rand(np.asarray(u), np.asarray(v)) for u, v in zip(p, q)])

    return picked.select(ari("la", "lb").alias("ari")).agg(F.avg("ari").alias("mean_ari"), F.stddev_pop("ari").alias("std_ari"), F.count(F.lit(1)).alias("n_pairs"))


def nested_cv_legacy(features: DataFrame, names: list[str] | None = None, repeats: int = 1000, inner_repeats: int = 10, outer_splits: int = 3, inner_splits: int = 2, max_k: int | None = None, seed: int = 1) -> DataFrame:
    """The older nested cross-validation of nearest neighbours on two classes, a row an outer split:
    (split, features, n_neighbors, validation_roc_auc, validation_accuracy, test_accuracy,
    test_roc_auc). The inner folds choose the feature subset, then the number of neighbours."""
    t = Table(features)
    if len(t.classes) != 2:
        raise ValueError("two classes are needed")
    names = names or [f"f{k}" for k in range(t.x.shape[1])]
    held = features.sparkSession.sparkContext.broadcast((t.x, t.y))

    def run(r):
        x, y = held.value
        train, test = list(m.repeated_stratified(y, outer_splits, r.repeat + 1, seed))[r.repeat * outer_splits + r.fold]
        chosen, accuracy, auc, k = m.select_legacy(x[train], y[train], inner_splits, inner_repeats, True, max_k, seed)
        s = m.scores(y[test], m.nearest_shares(x[train][:, chosen], y[train], x[test][:, chosen], k))
        return [(r.repeat * outer_splits + r.fold, [names[c] for c in chosen], k, auc, accuracy, s["accuracy"], s["roc_auc"])]

    work = [(i, f) for i in range(repeats) for f in range(outer_splits)]
    return _work(features, work, "repeat int, fold int", run, "split int, features array<string>, n_neighbors int, validation_roc_auc double, validation_accuracy double, test_accuracy double, test_roc_auc double")
