"""Measures of sliding windows along a plot's main diagonal, and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialise import materialised
from . import embed, lines, recurrence, short
from .measures import MEASURES, legacy_of, measures_of

PICKS = ("first", "middle", "last", "max", "avg", "mode", "median")


def _runs(series, tau, m, eps, dims):
    return lines.plot_runs(recurrence.recurrent_places(embed.delay_embed(series, tau, m), eps, m * dims, recurrence.tile_for(series)))


def check(window: int, step: int) -> None:
    if window < 1:
        raise ValueError("window_size must be positive")
    if step < 1:
        raise ValueError("window_step must be positive")


def windowed_histogram(series: DataFrame, window: int, step: int = 1, tau: int = 1, m: int = 1, eps: float = 0.5, dims: int = 1) -> DataFrame:
    """(sid, window_start, kind, len, cnt)."""
    check(window, step)
    return lines.windowed_runs(_runs(series, tau, m, eps, dims), window, step)


def windowed_measures(series: DataFrame, window: int, step: int = 1, tau: int = 1, m: int = 1, eps: float = 0.5, lmin: int = 2, dims: int = 1) -> DataFrame:
    """(sid, window_start, measures). Parameters are the whole series'; series shorter than a
    window have no rows."""
    check(window, step)
    if short.fits(recurrence.longest(series)):
        return short.windowed(series, window, step, tau, m, eps, lmin)
    return measures_of(windowed_histogram(series, window, step, tau, m, eps, dims), ("sid", "window_start"), lmin, window)


def windowed_measures_legacy(series: DataFrame, window: int, tau: int = 1, m: int = 1, eps: float = 0.5, lmin: int = 2, dims: int = 1) -> DataFrame:
    """(sid, window_start, nine measures), for windows at every place."""
    check(window, 1)
    if short.fits(recurrence.longest(series)):
        return short.windowed(series, window, 1, tau, m, eps, lmin, True)
    return legacy_of(windowed_histogram(series, window, 1, tau, m, eps, dims), ("sid", "window_start"), lmin, window)


def summarise(windowed: DataFrame, stats: tuple[str, ...] = ("mean", "median", "mode"), measures: tuple[str, ...] = MEASURES, more: tuple = ()) -> DataFrame:
    """(sid, <measure>__<stat>..., more aggregates); a mode of several values is the smallest."""
    made = {"mean": F.avg, "median": lambda c: F.percentile(c, 0.5), "mode": lambda c: F.mode(c, True)}
    if unknown := set(stats) - set(made):
        raise ValueError(f"Unknown statistics: {sorted(unknown)}")
    value = lambda m: F.when(~F.isnan(F.col(m).cast("double")), F.col(m).cast("double"))
    return windowed.groupBy("sid").agg(*(made[s](value(m)).alias(f"{m}__{s}") for m in measures for s in stats), *more)


def continuous_mode(values: DataFrame, key: str, value: str, bins: int = 10) -> DataFrame:
    """(key, mode): the middle of the fullest of equal bins; ties take the lowest."""
    ends = values.groupBy(key).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    # A constant column is spread to one half on either side, as histograms do.
    ends = ends.select(key, F.when(F.col("lo") == F.col("hi"), F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(F.col("lo") == F.col("hi"), F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    b = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)).cast("int")
    counted = values.join(ends, key).groupBy(key, b.alias("b"), "lo", "hi").agg(F.count(F.lit(1)).alias("c"))
    best = counted.groupBy(key, "lo", "hi").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
    return best.select(key, (F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / bins).alias("mode"))


def pick(windowed: DataFrame, measure: str, how: str) -> DataFrame:
    """(sid, <measure>): one value a series: the first, middle or last window's, or a summary."""
    if how == "mode":
        v = F.col(measure).cast("double")
        return continuous_mode(windowed.select("sid", v.alias("v")), "sid", "v").withColumnRenamed("mode", measure)
    return picks(windowed, measure, (how,)).withColumnRenamed(how, measure)


def picks(windowed: DataFrame, measure: str, hows: tuple[str, ...]) -> DataFrame:
    """(sid, <how>...): several choices of `pick`, all but the mode, in one pass over the windows."""
    v, at = F.col(measure).cast("double"), F.col("window_start")
    # The middle is the place ceil(n / 2), or the only window's.
    middle = lambda w: w[F.least(F.ceil(F.size(w) / 2), F.size(w) - 1).cast("int")]["v"]
    made = {"first": F.min_by(v, at), "middle": middle(F.array_sort(F.collect_list(F.struct(at, v.alias("v"))))), "last": F.max_by(v, at), "max": F.max(v), "avg": F.avg(v), "median": F.percentile(v, 0.5)}
    if unknown := set(hows) - set(made):
        raise ValueError(f"Unknown window choice: {', '.join(sorted(unknown))}")
    return windowed.groupBy("sid").agg(*(made[how].alias(how) for how in hows))


def pooled_histogram(series: DataFrame, window: int, kind: str = "diag", legacy: bool = False, **kw) -> DataFrame:
    """(sid, len, p, n_bar): mean of all windows' normalised histograms (bins of length 0 included),
    itself normalised, and the mean number of lines in a window, at least 1. In the older form a
    window's main diagonal and the zeros of its lower triangle, doubled, are diagonal lines too."""
    check(window, 1)
    if short.fits(recurrence.longest(series)):
        return short.pooled(series, window, kind, legacy, **{k: v for k, v in kw.items() if k != "dims"})
    hist = windowed_histogram(series, window, 1, **kw).where(F.col("kind") == kind)
    own = hist.select("sid", "window_start", "len", "cnt")
    if kind == "vert":
        sums = hist.groupBy("sid", "window_start").agg(F.sum(F.col("len") * F.col("cnt")).alias("ones"), F.sum("cnt").alias("runs"))
        own = own.union(sums.select("sid", "window_start", F.lit(0), F.lit(window * window + window) - F.col("ones") - F.col("runs")))
    elif legacy:
        # Lower triangle with its diagonal: runs and ones of one triangle, and the diagonal's own.
        all_windows = windowed_histogram(series, window, 1, **kw).groupBy("sid", "window_start").agg(
            F.coalesce(F.sum(F.when(F.col("kind") == "diag", F.col("len") * F.col("cnt"))), F.lit(0)).alias("ones"),
            F.coalesce(F.sum(F.when(F.col("kind") == "diag", F.col("cnt"))), F.lit(0)).alias("runs"),
        )
        zeros = F.lit(window * (window + 1)) - (F.col("ones") + 2 * window) - (F.col("runs") + 2) + 2 * window
        own = own.union(all_windows.select("sid", "window_start", F.lit(window), F.lit(1).cast("long"))).union(all_windows.select("sid", "window_start", F.lit(0), zeros)).where("cnt > 0")
    own = materialised(own)  # a row a window and length, used three times
    total = own.groupBy("sid", "window_start").agg(F.sum("cnt").alias("s"))
    share = own.join(total, ["sid", "window_start"]).groupBy("sid", "len").agg(F.sum(F.col("cnt") / F.col("s")).alias("p"))
    windows = series.groupBy("sid").agg((F.count(F.lit(1)) - (kw.get("m", 1) - 1) * kw.get("tau", 1) - window + 1).alias("w"))
    whole = total.groupBy("sid").agg(F.sum("s").alias("s")).join(windows, "sid").select("sid", F.greatest(F.lit(1), F.floor(F.col("s") / F.col("w"))).cast("int").alias("n_bar"))
    norm = share.groupBy("sid").agg(F.sum("p").alias("all"))
    return share.join(norm, "sid").join(whole, "sid").select("sid", "len", (F.col("p") / F.col("all")).alias("p"), "n_bar")
