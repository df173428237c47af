"""Feature tables: a row a series, with whole-series measures, window summaries and parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RqaConfig
from ..plans.materialise import materialised
from . import embed, information, lines, measures, parameters, recurrence, series as s, short, windows


def parameters_of(series: DataFrame, cfg: RqaConfig = RqaConfig(), dims: int = 1, tau: int | None = None, m: int | None = None, eps: float | None = None, group: bool = False) -> DataFrame:
    """(sid, tau, m, eps) of normalised series: searched, or as given; group puts one set, made of all
    series' own, in place of each. Under cfg.compat "legacy" the searches take their older
    forms, in which m and eps may be -1: not found."""
    sids = series.select("sid").distinct()
    dimension = parameters.embedding_dimension_legacy if cfg.legacy else parameters.embedding_dimension
    search = (lambda: information.delay_legacy(series, dims)) if cfg.legacy else (lambda: information.delay(series, dims, cfg.mi_method))
    # What is searched is a row a series, and used at every later stage: it is worked out once.
    t = sids.withColumn("tau", F.lit(tau)) if tau else materialised(search())
    if m:
        p = t.withColumn("m", F.lit(m))
    else:
        p = materialised(t.join(dimension(series, tau or t, cfg, dims), "sid"))
    if eps:
        p = p.withColumn("eps", F.lit(float(eps)))
    else:
        states = embed.delay_embed_by(series, p.where("m > 0"))
        radius = sids.join(parameters.radius_legacy(states, cfg), "sid", "left").select("sid", F.coalesce("eps", F.lit(-1.0)).alias("eps")) if cfg.legacy else parameters.radius(states, cfg, sids=sids)
        p = materialised(p.join(radius, "sid"))
    if group:
        p = sids.crossJoin(F.broadcast(parameters.group_parameters(p)))
    return p.select("sid", F.col("tau").cast("int").alias("tau"), F.col("m").cast("int").alias("m"), "eps")


def feature_table(series: DataFrame, window: int = 20, step: int = 10, stats: tuple[str, ...] = ("mean", "median", "mode"), cfg: RqaConfig = RqaConfig(), dims: int = 1, normalise: bool = True, labels: DataFrame | None = None, **given) -> DataFrame:
    """id, [label], the eleven measures, win_<measure>__<stat>, tau, m and eps. The plot's pairs are
    found once and serve both the whole series and the windows."""
    z = s.zscore(series, dims, 0.0 if cfg.legacy else 1e-10) if normalise else series
    p = parameters_of(z, cfg, dims, **given)
    if short.fits(n := recurrence.longest(z)):
        made = short.whole_and_windows(z, p.where("m > 0"), window, step, cfg.lmin)
        whole_row, names = F.col("window_start") < 0, measures.MEASURES
        own = made.select("sid", *(F.when(whole_row, F.col(c)).alias(f"_{c}") for c in names), *(F.when(~whole_row, F.col(c)).alias(c) for c in names))
        both = windows.summarise(own, stats, more=tuple(F.max(f"_{c}").alias(c) for c in names))
        out = both.select("sid", *names, *(F.col(c).alias(f"win_{c}") for c in both.columns if c not in ("sid", *names))).join(p, "sid")
    else:
        e = embed.delay_embed_by(z, p.where("m > 0"))
        runs = lines.plot_runs(recurrence.recurrent_places(e, p, tile=recurrence.tile_of(n)))
        whole = measures.measures_of(lines.runs_histogram(runs), lmin=cfg.lmin)
        cut = lines.windowed_runs(runs, window, step)
        summary = windows.summarise(measures.measures_of(cut, ("sid", "window_start"), cfg.lmin, window), stats)
        renamed = summary.select("sid", *(F.col(c).alias(f"win_{c}") for c in summary.columns if c != "sid"))
        out = whole.join(renamed, "sid", "left").join(p, "sid")
    if labels is not None:
        out = out.join(labels.select("sid", "label"), "sid")
    first = ["sid"] + (["label"] if labels is not None else [])
    return out.select(F.col("sid").alias("id"), *first[1:], *(c for c in out.columns if c not in first))


def feature_vectors(features: DataFrame) -> tuple[DataFrame, list[str]]:
    """(id, [label], features array) and the features' names; missing ones count as 0."""
    names = [c for c in features.columns if c not in ("id", "label", "grp")]
    extra = [c for c in ("label", "grp") if c in features.columns]
    return features.select("id", *extra, F.array(*(F.coalesce(F.col(f"`{n}`").cast("double"), F.lit(0.0)) for n in names)).alias("features")), names
