"""Recurrence quantification measures from line-length histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import embed, lines, recurrence

MEASURES = (
    "recurrence_rate", "determinism", "laminarity", "diagonal_entropy", "vertical_entropy", "average_diagonal_length",
    "average_vertical_length", "max_diagonal_length", "max_vertical_length", "diagonal_mode", "vertical_mode",
)
LEGACY_MEASURES = ("recc_rate", "percent_det", "avg_diag", "max_diag", "percent_lam", "avg_vert", "vert_ent", "diag_ent", "vert_max")


def line_aggregates(kind: str, lmin: int, guard: float = 1e-12) -> dict[str, Column]:
    """share, mean, entropy, mode and max of one kind of line, over rows (kind, len, cnt)."""
    own = F.col("kind") == kind
    long_ = own & (F.col("len") >= lmin)
    pick = lambda cond, v: F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))
    points = F.col("len") * F.col("cnt").cast("double")
    n_lines, n_logs = pick(long_, F.col("cnt").cast("double")), pick(long_, F.col("cnt") * F.ln(F.when(F.col("cnt") > 0, F.col("cnt"))))
    return {
        "share": pick(long_, points) / (pick(own & (F.col("len") >= 1), points) + guard),
        "mean": pick(long_, points) / (n_lines + guard),
        # -sum p ln p, with p = cnt / total
        "entropy": F.when(n_lines > 0, F.ln(F.when(n_lines > 0, n_lines)) - n_logs / F.when(n_lines > 0, n_lines)).otherwise(0.0),
        "mode": F.coalesce(F.max_by(F.when(long_, F.col("len")), F.when(long_, F.struct("cnt", -F.col("len")))), F.lit(lmin)),
        "max": F.coalesce(F.max(F.when(own & (F.col("len") >= 1) & (F.col("cnt") > 0), F.col("len"))), F.lit(1)),
    }


def measures_of(hist: DataFrame, keys: tuple[str, ...] = ("sid",), lmin: int = 2, side: int | None = None) -> DataFrame:
    """The eleven measures of each histogram. All ones of a plot lie on vertical runs, which gives the
    recurrence rate; the plot's side is that of its "size" run, or given."""
    d, v = line_aggregates("diag", lmin), line_aggregates("vert", lmin)
    ones = F.sum(F.when(F.col("kind") == "vert", F.col("len") * F.col("cnt")))
    n = F.lit(float(side)) if side else F.max(F.when(F.col("kind") == "size", F.col("len"))).cast("double")
    return hist.groupBy(*keys).agg(
        (F.coalesce(ones, F.lit(0)) / (n * n)).alias("recurrence_rate"), d["share"].alias("determinism"), v["share"].alias("laminarity"), d["entropy"].alias("diagonal_entropy"), v["entropy"].alias("vertical_entropy"),
        d["mean"].alias("average_diagonal_length"), v["mean"].alias("average_vertical_length"), d["max"].cast("int").alias("max_diagonal_length"),
        v["max"].cast("int").alias("max_vertical_length"), d["mode"].cast("int").alias("diagonal_mode"), v["mode"].cast("int").alias("vertical_mode"),
    ).select(*keys, *MEASURES)


def rqa_measures(series: DataFrame, tau: int = 1, m: int = 1, eps: float | DataFrame = 0.5, lmin: int = 2, dims: int = 1, params: DataFrame | None = None, tile: int | str | None = "auto") -> DataFrame:
    """The measures of each series; tau, m and eps for all, or by series from params (sid, tau, m, eps).
    Plots of short series are made in their tasks, pairs are dealt out by tiles where some series is long,
    unless tile says otherwise."""
    from . import short

    if tile == "auto":
        if short.fits(n := recurrence.longest(series)):
            return short.measures(series, tau, m, eps, lmin, params)
        tile = recurrence.tile_of(n)
    if params is not None:
        e, width, radius = embed.delay_embed_by(series, params), None, params.select("sid", "eps")
    else:
        e, width, radius = embed.delay_embed(series, tau, m), m * dims, eps
    places = recurrence.recurrent_places(e, radius, width, tile)
    return measures_of(lines.runs_histogram(lines.plot_runs(places)), lmin=lmin)


def rqa_measures_legacy(series: DataFrame, tau: int, m: int, eps: float, dims: int = 1, lmin: int = 2) -> DataFrame:
    """The nine measures of the older tables: the main diagonal counts as a line, the longest line
    has n - 2 points at most, and ratios are guarded by 1e-7."""
    from . import short

    if short.fits(n := recurrence.longest(series)):
        return short.measures(series, tau, m, eps, lmin, legacy=True)
    e = embed.delay_embed(series, tau, m)
    hist = lines.runs_histogram(lines.plot_runs(recurrence.recurrent_places(e, eps, m * dims, recurrence.tile_of(n))))
    return legacy_of(hist, ("sid",), lmin)


def legacy_of(hist: DataFrame, keys: tuple[str, ...], lmin: int = 2, side: int | None = None) -> DataFrame:
    """The nine measures; the main diagonal joins the diagonals as one line of the plot's side."""
    # The "size" run is that line: a second row of kind diag for it.
    own = F.array(F.struct(F.col("kind"), F.col("len"), F.col("cnt")))
    also = F.array(F.struct(F.lit("diag").alias("kind"), F.col("len"), F.col("cnt")))
    both = hist.select(*keys, F.explode(F.when(F.col("kind") == "size", F.concat(own, also)).otherwise(own)).alias("r")).select(*keys, "r.*")
    if side:
        ends = hist.select(*keys).distinct().select(*keys, F.lit("diag"), F.lit(side), F.lit(1).cast("long"))
        both = hist.select(*keys, "kind", "len", "cnt").union(ends)
    hist = both.groupBy(*keys, "kind", "len").agg(F.sum("cnt").alias("cnt"))
    n = F.lit(side) if side else F.max(F.when(F.col("kind") == "size", F.col("len"))).over(W.partitionBy(*keys))
    hist = hist.withColumn("n", n)
    d, v = line_aggregates("diag", lmin, 1e-7), line_aggregates("vert", lmin, 1e-7)
    longest = lambda kind: F.coalesce(F.max(F.when((F.col("kind") == kind) & (F.col("len") <= F.col("n") - 2) & (F.col("len") >= 1), F.col("len"))), F.lit(1)).cast("int")
    ones = F.sum(F.when(F.col("kind") == "vert", F.col("len") * F.col("cnt")))
    return hist.groupBy(*keys).agg(
        (ones / F.max(F.col("n").cast("double") * F.col("n"))).alias("recc_rate"), d["share"].alias("percent_det"), d["mean"].alias("avg_diag"), longest("diag").alias("max_diag"),
        v["share"].alias("percent_lam"), v["mean"].alias("avg_vert"), v["entropy"].alias("vert_ent"), d["entropy"].alias("diag_ent"), longest("vert").alias("vert_max"),
    )
