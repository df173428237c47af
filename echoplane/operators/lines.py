"""Line structures of recurrence plots: maximal runs, and histograms of their lengths.

Runs are found by gaps and islands: in a line, place minus row number is constant along
a run. A plot's columns equal its rows, so vertical runs come from the mirrored pairs.
With the pairs dealt by sid already, none of this shuffles again before the histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _islands(df: DataFrame, keys: tuple[str, ...], line: str, place: str) -> DataFrame:
    w = W.partitionBy(*keys, line).orderBy(place)
    run = df.select(*keys, F.col(line).alias("line"), F.col(place).alias("p"), (F.col(place) - F.row_number().over(w)).alias("_g"))
    return run.groupBy(*keys, "line", "_g").agg(F.min("p").alias("a"), F.max("p").alias("b")).select(*keys, "line", "a", "b")


def diagonal_runs(pairs: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, line, a, b): runs j = a..b on the diagonal i - j = line > 0."""
    return _islands(pairs.withColumn("k", F.col("i") - F.col("j")), keys, "k", "j")


def vertical_runs(plot: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, line, a, b): runs i = a..b in column line of the whole plot."""
    return _islands(plot, keys, "j", "i")


def run_lengths(runs: DataFrame, kind: str, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, kind, len, cnt); diagonals stand for both triangles."""
    times = 2 if kind == "diag" else 1
    length = (F.col("b") - F.col("a") + 1).alias("len")
    return runs.groupBy(*keys, length).agg((times * F.count(F.lit(1))).alias("cnt")).select(*keys, F.lit(kind).alias("kind"), "len", "cnt")


def histogram(diag: DataFrame, vert: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """Both kinds' run lengths. Zeros of the plot, which count as lines of length 0, are left out."""
    return run_lengths(diag, "diag", keys).unionByName(run_lengths(vert, "vert", keys))


def full_histogram(runs: DataFrame, size: DataFrame, kind: str, compat: str = "current") -> DataFrame:
    """(sid, len, cnt) with the bin of length 0 as the method's tables have it.

    vert: zeros - runs + n. diag: 0, or under "legacy" with the main diagonal as one more
    line of length n and 2 (zeros of the lower triangle - runs + n)."""
    lengths = run_lengths(runs, kind).select("sid", "len", "cnt")
    totals = runs.groupBy("sid").agg(F.sum(F.col("b") - F.col("a") + 1).alias("ones"), F.count(F.lit(1)).alias("runs"))
    base = size.join(totals, "sid", "left").select("sid", F.col("n").cast("long").alias("n"), F.coalesce("ones", F.lit(0)).alias("ones"), F.coalesce("runs", F.lit(0)).alias("runs"))
    if kind == "vert":
        zero = F.expr("n * n - ones - runs + n")
    elif compat == "current":
        return lengths
    else:  # the main diagonal's run and ones belong to the lower triangle here
        zero = F.expr("2 * ((n * (n + 1)) div 2 - (ones + n) - (runs + 1) + n)")
        lengths = lengths.union(base.select("sid", F.col("n").cast("int"), F.lit(1).cast("long"))).groupBy("sid", "len").agg(F.sum("cnt").alias("cnt"))
    return lengths.union(base.select("sid", F.lit(0), zero)).where("cnt > 0").toDF("sid", "len", "cnt")


def plot_runs(places: DataFrame) -> DataFrame:
    """(sid, kind, line, a, b): all runs of a plot from its lower half (main diagonal included), in one
    pass. A place adds to its diagonal, and to its column and its row; the main diagonal adds to
    one column and is itself a run, of kind "size", whose length is the plot's side."""
    at = lambda kind, line, place: F.struct(F.lit(kind).alias("kind"), line.alias("line"), place.alias("p"))
    i, j = F.col("i"), F.col("j")
    parts = F.when(i == j, F.array(at("vert", i, i), at("size", F.lit(0), i))).otherwise(F.array(at("diag", i - j, j), at("vert", j, i), at("vert", i, j)))
    rows = places.select("sid", F.explode(parts).alias("r")).select("sid", "r.kind", "r.line", "r.p")
    w = W.partitionBy("sid", "kind", "line").orderBy("p")
    run = rows.withColumn("_g", F.col("p") - F.row_number().over(w))
    return run.groupBy("sid", "kind", "line", "_g").agg(F.min("p").alias("a"), F.max("p").alias("b")).drop("_g")


def runs_histogram(runs: DataFrame) -> DataFrame:
    """(sid, kind, len, cnt) of `plot_runs`; diagonals stand for both triangles."""
    counts = runs.groupBy("sid", "kind", (F.col("b") - F.col("a") + 1).alias("len")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("cnt", F.when(F.col("kind") == "diag", 2 * F.col("cnt")).otherwise(F.col("cnt")))


def windowed_runs(runs: DataFrame, window: int, step: int) -> DataFrame:
    """(sid, window_start, kind, len, cnt): histograms of all windows along the main diagonal.

    A run cut to a window is a run of the window, so plots are not scanned again: each run
    is sent to the windows that it meets, cut to size. A column meets a window if its own place
    is inside; a diagonal at distance k from the main one has k places less."""
    side = F.max(F.when(F.col("kind") == "size", F.col("b") + 1)).over(W.partitionBy("sid"))
    r = runs.withColumn("n", side).where((F.col("kind") != "size") & (F.col("n") >= window))
    diag, k, top = F.col("kind") == "diag", F.col("line"), F.col("n") - window
    r = r.where(~diag | (k < window))
    lo = F.when(diag, F.col("a") - (window - 1 - k)).otherwise(F.greatest(k, "a") - window + 1)
    hi = F.when(diag, F.col("b")).otherwise(F.least(k, "b"))
    r = _spread(r, F.greatest(F.lit(0), lo), F.least(hi, top), step)
    end = F.col("s") + window - 1 - F.when(diag, k).otherwise(0)
    length = F.least(F.col("b"), end) - F.greatest("a", "s") + 1
    counts = r.groupBy("sid", F.col("s").alias("window_start"), "kind", length.alias("len")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.withColumn("cnt", F.when(F.col("kind") == "diag", 2 * F.col("cnt")).otherwise(F.col("cnt")))


def _spread(df: DataFrame, lo, hi, step: int) -> DataFrame:
    first = F.ceil(lo / step) * step
    df = df.withColumn("_f", first.cast("int")).withColumn("_h", hi.cast("int")).where("_f <= _h")
    return df.withColumn("s", F.explode(F.sequence("_f", "_h", F.lit(step)))).drop("_f", "_h")
