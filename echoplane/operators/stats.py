"""Tests and scores over tables of results, features and predictions."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..ml.models import nearest_rows
from ..plans.materialise import materialised


def rank_p_value(real: DataFrame, null: DataFrame, keys: tuple[str, ...], value: str = "value", side: str = "greater") -> DataFrame:
    """(keys, p): (nulls at least as extreme + 1) / (nulls + 1)."""
    n, r = F.col("null_v"), F.col("real_v")
    as_far = (n >= r) if side == "greater" else (n <= r)
    j = real.select(*keys, F.col(value).alias("real_v")).join(null.select(*keys, F.col(value).alias("null_v")), list(keys))
    return j.groupBy(*keys).agg(((F.sum(as_far.cast("int")) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def benjamini_hochberg(p: DataFrame, alpha: float = 0.05, family: tuple[str, ...] = (), value: str = "p") -> DataFrame:
    """p with p_adjusted and significant; ranks within each family. A family is a set of tests: its
    size is the number of hypotheses, not of rows of data."""
    w = W.partitionBy(*(family or (F.lit(0),)))
    ranked = p.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_m", F.count(F.lit(1)).over(w))
    from_top = w.orderBy(F.desc("_r")).rowsBetween(W.unboundedPreceding, 0)
    adjusted = F.least(F.lit(1.0), F.min(F.col(value) * F.col("_m") / F.col("_r")).over(from_top))
    return ranked.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") <= alpha).drop("_r", "_m")


def bonferroni(p: DataFrame, alpha: float = 0.05, family: tuple[str, ...] = (), value: str = "p") -> DataFrame:
    w = W.partitionBy(*(family or (F.lit(0),)))
    adjusted = F.least(F.lit(1.0), F.col(value) * F.count(F.lit(1)).over(w))
    return p.withColumn("p_adjusted", adjusted).withColumn("significant", F.col("p_adjusted") <= alpha)


def cohens_d(real: DataFrame, null: DataFrame, keys: tuple[str, ...], value: str = "value") -> DataFrame:
    """(keys, d): how many deviations of the nulls the real value is from their mean."""
    n = null.groupBy(*keys).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return real.join(n, list(keys)).select(*keys, ((F.col(value) - F.col("m")) / F.greatest("s", F.lit(1e-12))).alias("d"))


def wilcoxon(pairs: DataFrame, a: str, b: str, keys: tuple[str, ...]) -> DataFrame:
    """(keys, statistic, effect_size): the smaller signed rank sum of the differences that are not
    zero, ties sharing ranks, and 1 - 2 W / (n (n + 1) / 2) with n all pairs."""
    d = pairs.select(*keys, (F.col(a) - F.col(b)).alias("d"))
    n = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    some = d.where("d <> 0").withColumn("s", F.abs("d"))
    w = W.partitionBy(*keys).orderBy("s")
    shared = F.rank().over(w) + (F.count(F.lit(1)).over(W.partitionBy(*keys, "s")) - 1) / 2.0
    sums = some.withColumn("r", shared).groupBy(*keys).agg(F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"))
    stat = F.coalesce(F.least("up", "down"), F.lit(0.0))
    effect = F.when(F.col("up").isNull(), 0.0).otherwise(1 - 2 * stat / (F.col("n") * (F.col("n") + 1) / 2))
    return n.join(sums, list(keys), "left").select(*keys, stat.alias("statistic"), effect.alias("effect_size"))


def confusion(pred: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(y, yhat, n)."""
    return pred.groupBy(F.col(y).alias("y"), F.col(yhat).alias("yhat")).agg(F.count(F.lit(1)).alias("n"))


def classification_scores(pred: DataFrame, keys: tuple[str, ...] = (), y: str = "y", yhat: str = "yhat") -> DataFrame:
    """(keys, accuracy, balanced_accuracy, f1_macro). Classes are those in y or yhat."""
    one = pred.select(*keys, F.col(y).alias("y"), F.col(yhat).alias("yhat"))
    true = one.groupBy(*keys, F.col("y").alias("c")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("y") == F.col("yhat")).cast("int")).alias("tp"), F.lit(0).cast("long").alias("k"))
    said = one.groupBy(*keys, F.col("yhat").alias("c")).agg(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("tp"), F.count(F.lit(1)).alias("k"))
    per = true.unionByName(said).groupBy(*keys, "c").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("k").alias("k"))
    f1 = 2 * F.col("tp") / (F.col("n") + F.col("k"))
    return per.groupBy(*keys).agg((F.sum("tp") / F.sum("n")).alias("accuracy"), F.avg(F.when(F.col("n") > 0, F.col("tp") / F.col("n"))).alias("balanced_accuracy"), F.avg(f1).alias("f1_macro"))


def roc_auc(pred: DataFrame, score: str, positive: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, auc) by average ranks; null where one class is missing. Scores are dealt to partitions by
    range: ranks run within a partition, on top of the counts of those before it."""
    part = keys or ("_all",)
    one = pred.withColumn("_all", F.lit(0)).select(*part, F.col(score).alias("s"), positive.cast("int").alias("p"))
    per = one.groupBy(*part, "s").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("np"))
    # Written, for a range's number must not change when it is read again.
    per = materialised(per.repartitionByRange(*part, "s").withColumn("_range", F.spark_partition_id()))
    ranges = per.groupBy(*part, "_range").agg(F.sum("n").alias("c"))
    so_far = W.partitionBy(*part).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.select(*part, "_range", F.coalesce(F.sum("c").over(so_far), F.lit(0)).alias("offset"))
    within = W.partitionBy(*part, "_range").orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("n").over(within), F.lit(0))
    ranked = per.join(ranges, [*part, "_range"]).withColumn("r", before + (F.col("n") + 1) / 2.0)
    total = ranked.groupBy(*part).agg(F.sum(F.col("np") * F.col("r")).alias("rs"), F.sum("np").alias("p"), F.sum("n").alias("n"))
    auc = F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * (F.col("n") - F.col("p")))
    return total.select(*keys, auc.alias("auc"))


def adjusted_rand(labels: DataFrame, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, ari) of two labellings."""
    two = lambda c: F.col(c) * (F.col(c) - 1) / 2.0
    part = keys or ("_all",)
    cells = labels.withColumn("_all", F.lit(0)).groupBy(*part, a, b).agg(F.count(F.lit(1)).alias("n"))
    s = cells.groupBy(*part).agg(F.sum(two("n")).alias("s"), F.sum("n").alias("total"))
    sa = cells.groupBy(*part, a).agg(F.sum("n").alias("n")).groupBy(*part).agg(F.sum(two("n")).alias("sa"))
    sb = cells.groupBy(*part, b).agg(F.sum("n").alias("n")).groupBy(*part).agg(F.sum(two("n")).alias("sb"))
    j = s.join(sa, list(part)).join(sb, list(part))
    expected = F.col("sa") * F.col("sb") / (F.col("total") * (F.col("total") - 1) / 2.0)
    top = (F.col("sa") + F.col("sb")) / 2
    return j.select(*keys, F.coalesce(F.try_divide(F.col("s") - expected, top - expected), F.lit(1.0)).alias("ari"))


def _long(points: DataFrame) -> DataFrame:
    return points.select("id", "label", F.posexplode("features").alias("pos", "v"))


def centroids(points: DataFrame) -> DataFrame:
    """(label, pos, c, n) of points (id, label, features)."""
    return _long(points).groupBy("label", "pos").agg(F.avg("v").alias("c"), F.count(F.lit(1)).alias("n"))


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """(score): dispersion between clusters over that within them."""
    c = centroids(points)
    within = _long(points).join(c, ["label", "pos"]).agg(F.sum(F.pow(F.col("v") - F.col("c"), 2)).alias("w"))
    mean = c.groupBy("pos").agg((F.sum(F.col("c") * F.col("n")) / F.sum("n")).alias("m"))
    between = c.join(mean, "pos").agg(F.sum(F.col("n") * F.pow(F.col("c") - F.col("m"), 2)).alias("b"))
    size = c.where("pos = 0").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"))
    j = within.crossJoin(between).crossJoin(size)  # three tables of one row
    return j.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("score"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """(score): mean over clusters of the worst ratio of spreads to distance of centroids. The pairs
    are pairs of clusters."""
    c = centroids(points)
    d = _long(points).join(c, ["label", "pos"]).groupBy("label", "id").agg(F.sqrt(F.sum(F.pow(F.col("v") - F.col("c"), 2))).alias("d"))
    spread = d.groupBy("label").agg(F.avg("d").alias("s"))
    a, b = c.select(F.col("label").alias("la"), "pos", F.col("c").alias("ca")), c.select(F.col("label").alias("lb"), "pos", F.col("c").alias("cb"))
    gap = a.join(b, "pos").where("la <> lb").groupBy("la", "lb").agg(F.sqrt(F.sum(F.pow(F.col("ca") - F.col("cb"), 2))).alias("g"))
    s1, s2 = spread.toDF("la", "sa"), spread.toDF("lb", "sb")
    ratio = gap.join(s1, "la").join(s2, "lb").select("la", ((F.col("sa") + F.col("sb")) / F.col("g")).alias("r"))
    return ratio.groupBy("la").agg(F.max("r").alias("r")).agg(F.avg("r").alias("score"))


#: Points in a block, at most: a task holds two blocks and their distances, slice by slice.
BLOCK_POINTS = 16_384


def _cells(left: DataFrame, right: DataFrame, run, schema: str) -> DataFrame:
    """run(left rows, right rows) for every pair of a block of left and a block of right, each pair in a task
    of its own. Every point meets every other, by definition; numbers of wide vectors are compared in
    arrays, for an expression of so many terms is past what the JVM compiles."""
    spark = left.sparkSession
    least = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    n_p, n_q = (max(least, math.ceil(df.count() / BLOCK_POINTS)) for df in (left, right))
    own = lambda df, n: F.pmod(F.xxhash64(df.columns[0]), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = left.withColumn("_p", own(left, n_p)).withColumn("_q", every(n_q))
    b = right.withColumn("_q", own(right, n_q)).withColumn("_p", every(n_p))
    cell = lambda x, y: run(x, y) if x.num_rows and y.num_rows else run.none
    return a.groupBy("_p", "_q").cogroup(b.groupBy("_p", "_q")).applyInArrow(cell, schema)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(len(column), -1)


#: Distances that a task holds at a time.
SLICE = 1 << 21


def _distances(x: np.ndarray, y: np.ndarray):
    """(from, distances) of slices of x to all of y, by inner products of centred rows; pairs that are so near that
    this would leave few of their digits are measured coordinate by coordinate."""
    centre = y.mean(axis=0)
    a, b = x - centre, y - centre
    aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    twice, step = np.ascontiguousarray(-2 * b.T), max(1, SLICE // max(1, len(y)))
    for s in range(0, len(x), step):
        d = a[s : s + step] @ twice
        d += bb
        d += aa[s : s + step, None]
        i, j = np.nonzero(d <= 1e-6 * (aa[s : s + step].max(initial=0.0) + bb.max(initial=0.0)))
        d[i, j] = ((x[s + i] - y[j]) ** 2).sum(axis=1)
        yield s, np.sqrt(d, out=d)


def silhouette(points: DataFrame) -> DataFrame:
    """(score): mean silhouette by Euclidean distances; a point alone in its cluster scores 0."""
    p = points.select("id", "label", "features")
    kinds = [p.schema[c].dataType.simpleString() for c in ("id", "label")]
    names = ["ia", "la", "lb", "total", "n"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        ids, own = x.column("id").combine_chunks(), x.column("label").combine_chunks()
        codes = y.column("label").combine_chunks().dictionary_encode()
        code, k = codes.indices.to_numpy(), len(codes.dictionary)
        where = {v: i for i, v in enumerate(ids.to_pylist())}
        same = [(where[v], j) for j, v in enumerate(y.column("id").to_pylist()) if v in where]
        total, n = np.zeros((x.num_rows, k)), np.tile(np.bincount(code, minlength=k), (x.num_rows, 1))
        hot = np.eye(k)[code]
        fy = _matrix(y.column("features"))
        for s, d in _distances(_matrix(x.column("features")), fy):
            total[s : s + len(d)] = d @ hot
        for i, j in same:  # a point is not its own neighbour; its distance to itself is 0
            n[i, code[j]] -= 1
        i, c = np.nonzero(n)
        return pa.table([ids.take(pa.array(i)), own.take(pa.array(i)), codes.dictionary.take(pa.array(c)), pa.array(total[i, c]), pa.array(n[i, c])], names=names)

    types = [pa.int64() if k == "bigint" else pa.int32() if k == "int" else pa.string() for k in kinds]
    run.none = pa.table([pa.array([], t) for t in (types[0], types[1], types[1], pa.float64(), pa.int64())], names=names)
    to = _cells(p, p, run, f"ia {kinds[0]}, la {kinds[1]}, lb {kinds[1]}, total double, n long").groupBy("ia", "la", "lb").agg((F.sum("total") / F.sum("n")).alias("m"))
    per = to.groupBy("ia").agg(F.min(F.when(F.col("la") == F.col("lb"), F.col("m"))).alias("own"), F.min(F.when(F.col("la") != F.col("lb"), F.col("m"))).alias("other"))
    s = F.when(F.col("own").isNull(), 0.0).otherwise((F.col("other") - F.col("own")) / F.greatest("own", "other"))
    return per.agg(F.avg(s).alias("score"))


def knn_predict(train: DataFrame, test: DataFrame, k: int = 5, leave_one_out: bool = False) -> DataFrame:
    """(id, yhat): the most frequent label of the k nearest training points (ties: nearest id first,
    least label); leave_one_out keeps a point from voting for itself. A pair of blocks keeps each
    test point's k best."""
    a, b = test.select("id", "features"), train.select(F.col("id").alias("tid"), "label", F.col("features").alias("f"))
    kinds = [a.schema["id"].dataType.simpleString(), b.schema["tid"].dataType.simpleString(), b.schema["label"].dataType.simpleString()]
    names = ["id", "tid", "label", "d"]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.sort_by("tid")  # a stable sort then takes equal distances by id
        ids, tids = x.column("id").to_pylist(), y.column("tid").to_pylist()
        where, fy = {v: j for j, v in enumerate(tids)}, _matrix(y.column("f"))
        # One more than k, for the point itself; each row's own place, or -1.
        near, dist = nearest_rows(_matrix(x.column("features")), fy, k + 1 if leave_one_out else k)
        own = np.array([where.get(v, -1) for v in ids]) if leave_one_out else np.full(len(ids), -1)
        ok = near != own[:, None]
        ok &= np.cumsum(ok, axis=1) <= k
        i, j = pa.array(np.nonzero(ok)[0]), pa.array(near[ok])
        return pa.table([x.column("id").combine_chunks().take(i), y.column("tid").combine_chunks().take(j), y.column("label").combine_chunks().take(j), pa.array(dist[ok])], names=names)

    types = [pa.int64() if t == "bigint" else pa.int32() if t == "int" else pa.string() for t in kinds]
    run.none = pa.table([pa.array([], t) for t in (*types, pa.float64())], names=names)
    best = _cells(a, b, run, f"id {kinds[0]}, tid {kinds[1]}, label {kinds[2]}, d double")
    best = best.withColumn("r", F.row_number().over(W.partitionBy("id").orderBy("d", "tid"))).where(F.col("r") <= k)
    votes = best.groupBy("id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy("id").agg(F.min(F.struct(-F.col("n"), "label")).alias("v")).select("id", F.col("v.label").alias("yhat"))


def gaussian_nb_predict(train: DataFrame, test: DataFrame, smoothing: float = 1e-9) -> DataFrame:
    """(id, yhat) by Gaussian naive Bayes; variances get smoothing times the largest variance."""
    long = train.select("label", F.posexplode("features").alias("pos", "v"))
    per = long.groupBy("label", "pos").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s2"), F.count(F.lit(1)).alias("n"))
    extra = long.groupBy("pos").agg(F.var_pop("v").alias("s2")).agg((smoothing * F.max("s2")).alias("e"))
    total = train.agg(F.count(F.lit(1)).alias("total"))
    model = per.crossJoin(extra).crossJoin(total).select("label", "pos", "m", (F.col("s2") + F.col("e")).alias("s2"), (F.col("n") / F.col("total")).alias("prior"))
    t = test.select("id", F.posexplode("features").alias("pos", "v")).join(model, "pos")
    like = t.groupBy("id", "label").agg((F.sum(-0.5 * F.ln(6.283185307179586 * F.col("s2")) - F.pow(F.col("v") - F.col("m"), 2) / (2 * F.col("s2"))) + F.ln(F.first("prior"))).alias("l"))
    return like.groupBy("id").agg(F.max_by("label", F.struct("l", -F.col("label"))).alias("yhat"))


def stratified_folds(points: DataFrame, k: int, seed: int = 42, label: str = "label", key: str = "id") -> DataFrame:
    """(key, label, fold): each label's rows dealt to k folds in turn, in order of a seeded hash."""
    w = W.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)
    return points.select(key, label, ((F.row_number().over(w) - 1) % k).alias("fold"))
