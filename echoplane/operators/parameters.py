"""Embedding dimension by false nearest neighbours, and the radius by target recurrence rate.

Both sweep a grid of hundreds of thresholds. No row is ever met with the grid: a
distance falls into the grid step from which on it counts, and running sums over steps
give the whole curve."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import RqaConfig
from ..plans.materialise import materialised as cut
from . import embed, recurrence, short

GUARD, LEGACY_GUARD = 1e-12, 1e-9


def neighbour_ratios(series: DataFrame, tau: int | DataFrame, m: int, dims: int = 1) -> DataFrame:
    """(sid, t, d_m, d_next): for each state with a later sample, the distance to its nearest
    neighbour in m dimensions, and what it is in m + 1. Neighbours without a later sample are
    left out."""
    if isinstance(tau, DataFrame):
        p = tau.select("sid", "tau")
        small, large = (embed.delay_embed_by(series, p.withColumn("m", F.lit(k))) for k in (m, m + 1))
    else:
        small, large = embed.delay_embed(series, tau, m), embed.delay_embed(series, tau, m + 1)
    nn = recurrence.nearest_neighbours(small, m * dims)
    a, b = large.select("sid", "t", F.col("e").alias("ea")), large.select("sid", F.col("t").alias("nn"), F.col("e").alias("eb"))
    both = nn.join(a, ["sid", "t"]).join(b, ["sid", "nn"])
    return both.select("sid", "t", (F.col("d") + GUARD).alias("d_m"), recurrence.distance((m + 1) * dims).alias("d_next"))


def fnn_ratio(series: DataFrame, tau: int, m: int, r: float, dims: int = 1, sigma: DataFrame | None = None, legacy: bool = False) -> DataFrame:
    """(sid, fnn): share of near neighbours that are false at threshold r. sigma is (sid, sd),
    by default three deviations."""
    near = neighbour_ratios_upto(series, tau, m, dims, legacy=True).where(F.col("m") == m) if legacy else neighbour_ratios(series, tau, m, dims)
    near = near.join(sigma if sigma is not None else deviation(series), "sid")
    is_near = F.col("d_m") < F.col("sd") / r
    false = is_near & (F.col("d_next") / F.col("d_m") > r)
    return near.groupBy("sid").agg((F.sum(false.cast("int")) / (F.sum(is_near.cast("int")) + (LEGACY_GUARD if legacy else GUARD))).alias("fnn"))


def deviation(series: DataFrame) -> DataFrame:
    """(sid, sd): three population deviations of all values of a series."""
    return series.select("sid", F.explode("x").alias("v")).groupBy("sid").agg((3 * F.stddev_pop("v")).alias("sd"))


def _steps(value, lo: float, hi: float, n: int):
    """Number of grid points of linspace(lo, hi, n) that are below value: it counts at those."""
    step = (hi - lo) / (n - 1)
    return F.least(F.lit(n), F.greatest(F.lit(0), F.ceil((value - lo) / step))).cast("int")


def fnn_curve(series: DataFrame, tau: int | DataFrame, m: int, cfg: RqaConfig = RqaConfig(), dims: int = 1) -> DataFrame:
    """(sid, r_index, fnn) along the whole grid of thresholds."""
    return _curve(neighbour_ratios(series, tau, m, dims).join(deviation(series), "sid"), cfg, ("sid",))


def _curve(near: DataFrame, cfg: RqaConfig, keys: tuple[str, ...], guard: float = GUARD) -> DataFrame:
    grid = lambda v: _steps(v, cfg.rmin, cfg.rmax, cfg.rdiv)
    # Near at r if r < sd / d_m; false at r if besides r < d_next / d_m.
    n_near, n_false = grid(F.col("sd") / F.col("d_m")), grid(F.least(F.col("sd") / F.col("d_m"), F.col("d_next") / F.col("d_m")))
    marks = near.select(*keys, F.explode(F.array(F.struct(n_near.alias("k"), F.lit(1).alias("near"), F.lit(0).alias("false")), F.struct(n_false.alias("k"), F.lit(0).alias("near"), F.lit(1).alias("false")))).alias("s"))
    counts = marks.groupBy(*keys, "s.k").agg(F.sum("s.near").alias("near"), F.sum("s.false").alias("false"))
    # One array of counts a curve, summed from its end; then a row for each step.
    held = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("near", "false")))).alias("c"))
    at = lambda k, f: F.coalesce(F.col("c")[k][f], F.lit(0))
    rows = held.select(*keys, "c", F.explode(F.sequence(F.lit(1), F.lit(cfg.rdiv))).alias("k")).select(*keys, "k", at(F.col("k"), "near").alias("near"), at(F.col("k"), "false").alias("false"))
    up = W.partitionBy(*keys).orderBy(F.desc("k")).rowsBetween(W.unboundedPreceding, 0)
    return rows.select(*keys, (F.col("k") - 1).alias("r_index"), (F.sum("false").over(up) / (F.sum("near").over(up) + guard)).alias("fnn"))


def _states(series: DataFrame, tau: int | DataFrame, top: int, dims: int) -> DataFrame:
    """(sid, t, e0.0, ..): each sample with the top samples that follow it tau apart, null past the end. A
    sample is sent to the states that it is part of, so series of any length are dealt to all tasks."""
    s = series.join(tau.select("sid", "tau"), "sid") if isinstance(tau, DataFrame) else series.withColumn("tau", F.lit(tau))
    sent = s.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(top)))).select("sid", (F.col("t") - F.col("tau") * F.col("q")).alias("t"), "q", "x").where("t >= 0")
    return sent.groupBy("sid", "t").agg(*(F.max(F.when(F.col("q") == q, F.col("x")[c])).alias(f"e{q}_{c}") for q in range(top + 1) for c in range(dims)))


def _partial_sums(top: int, dims: int, a: str, b: str) -> list[Column]:
    """Squared distances in 1 .. top + 1 dimensions; null where either state ends before."""
    out: list[Column] = []
    for q in range(top + 1):
        total = out[-1] if out else None
        for c in range(dims):
            g = F.col(f"{a}e{q}_{c}") - F.col(f"{b}e{q}_{c}")
            total = g * g if total is None else total + g * g
        out.append(total)
    return out


def neighbour_ratios_upto(series: DataFrame, tau: int | DataFrame, top: int, dims: int = 1, tile: int | None = recurrence.TILE, legacy: bool = False) -> DataFrame:
    """(sid, t, m, d_m, d_next) for m = 1 .. top; with legacy, neighbours are those of
    `recurrence.nearest_neighbours_legacy`, and distances are guarded by 1e-9.

    A pair of states gives its distances in all dimensions at once, as partial sums. Two passes
    over the pairs take plain minima, first of the distances and then of the places that have
    them, so partial aggregation next to the join leaves a row a state: pairs are never shuffled. Series that
    are short are worked out in their tasks."""
    if tile == recurrence.TILE and short.fits(recurrence.longest(series)):
        return short.neighbour_ratios(series, tau, top, legacy, LEGACY_GUARD if legacy else GUARD)
    states = cut(_states(series, tau, top, dims))
    cols = [c for c in states.columns if c not in ("sid", "t")]
    side = lambda p, at: states.select("sid", F.col("t").alias(at), *(F.col(c).alias(p + c) for c in cols))
    d = [F.sqrt(x) for x in _partial_sums(top, dims, "a", "b")]
    near = [F.when(d[m].isNotNull(), d[m - 1]) if legacy else d[m - 1] for m in range(1, top + 1)]
    met = lambda a: recurrence._met(a, side("b", "j"), ("sid",), tile, both=True).where("i <> j")
    least = met(side("a", "i")).groupBy("sid", "i").agg(*(F.min(x).alias(f"d{m}") for m, x in enumerate(near, 1)))
    known = side("a", "i").join(least, ["sid", "i"])

    def place(m: int) -> Column:
        first = F.min(F.when(near[m - 1] == F.col(f"d{m}"), F.col("j")))
        if not legacy:
            return first
        # State 0 takes the last state that takes part, if it is among the nearest.
        last = F.max(F.when((F.col("i") == 0) & (near[m - 1] == F.col(f"d{m}")) & (F.col("j") == F.col("n") - m * F.col("tau") - 1), F.col("j")))
        return F.coalesce(last, first)

    if legacy:
        known = known.join(_lengths(series, tau), "sid")
    at = met(known).groupBy("sid", "i").agg(*(place(m).alias(f"j{m}") for m in range(1, top + 1)))
    long = at.select("sid", "i", F.posexplode(F.array(*(f"j{m}" for m in range(1, top + 1)))).alias("m", "j")).where("j is not null")
    both = long.join(side("a", "i"), ["sid", "i"]).join(side("b", "j"), ["sid", "j"]).select("sid", F.col("i").alias("t"), (F.col("m") + 1).alias("m"), F.array(*d).alias("d"))
    guard = LEGACY_GUARD if legacy else GUARD
    return both.select("sid", "t", "m", (F.element_at("d", F.col("m")) + guard).alias("d_m"), F.element_at("d", F.col("m") + 1).alias("d_next")).where("d_next is not null")


def fnn_zero_upto(series: DataFrame, tau: int | DataFrame, top: int, cfg: RqaConfig = RqaConfig(), dims: int = 1, legacy: bool = False) -> DataFrame:
    """(sid, m, r0) for m = 1 .. top: the least threshold whose false share is under delta, or -1 where
    there is none or the series has (m + 1) * tau samples or fewer. In the older form a series may
    be as short as m * tau + 1 samples, and one state alone has no false neighbour."""
    step = (cfg.rmax - cfg.rmin) / (cfg.rdiv - 1)
    if short.fits(recurrence.longest(series)):
        n = short.false_neighbours(series, tau, top, legacy, LEGACY_GUARD if legacy else GUARD, (cfg.rmin, cfg.rmax, cfg.rdiv), cfg.delta).withColumn("k", F.when(F.col("k") >= 0, F.col("k")))
        return _zero(n, step, cfg, legacy)
    curve = _curve(neighbour_ratios_upto(series, tau, top, dims, legacy=legacy).join(deviation(series), "sid"), cfg, ("sid", "m"), LEGACY_GUARD if legacy else GUARD)
    hit = curve.where(F.col("fnn") < cfg.delta).groupBy("sid", "m").agg(F.min("r_index").alias("k"))
    n = _lengths(series, tau).withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(top))))
    return _zero(n.join(hit, ["sid", "m"], "left"), step, cfg, legacy)


def _zero(n: DataFrame, step: float, cfg: RqaConfig, legacy: bool) -> DataFrame:
    """(sid, m, r0) from (sid, n, tau, m, k): the place k of the grid, or null where none was found."""
    found = F.when((F.lit(legacy) | (F.col("n") > (F.col("m") + 1) * F.col("tau"))) & F.col("k").isNotNull(), cfg.rmin + F.col("k") * step)
    if legacy:
        found = F.when(F.col("n") == F.col("m") * F.col("tau") + 1, cfg.rmin).when(F.col("n") > F.col("m") * F.col("tau"), found)
    return n.select("sid", "m", F.coalesce(found, F.lit(-1.0)).alias("r0"))


def fnn_zero(series: DataFrame, tau: int | DataFrame, m: int, cfg: RqaConfig = RqaConfig(), dims: int = 1, legacy: bool = False) -> DataFrame:
    """(sid, m, r0) for one m."""
    return fnn_zero_upto(series, tau, m, cfg, dims, legacy).where(F.col("m") == m)


def _lengths(series: DataFrame, tau: int | DataFrame) -> DataFrame:
    n = series.groupBy("sid").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.join(tau.select("sid", "tau"), "sid") if isinstance(tau, DataFrame) else n.withColumn("tau", F.lit(tau))


def embedding_dimension(series: DataFrame, tau: int | DataFrame, cfg: RqaConfig = RqaConfig(), dims: int = 1) -> DataFrame:
    """(sid, m): the largest q + 1 whose threshold drops by more than bound from q to q + 1 (with
    both found, q up to mmax), else mmax."""
    top = min((3 * dims + 11) // 2, 10)
    zero = fnn_zero_upto(series, tau, top + 1, cfg, dims)
    short = F.greatest(F.lit(1), F.floor((F.col("n") - F.col("tau")) / F.col("tau")).cast("int"))
    n = _lengths(series, tau).select("sid", F.when(F.col("n") <= (top + 1) * F.col("tau"), F.least(F.lit(top), short)).otherwise(top).alias("mmax"))
    after = F.lead("r0").over(W.partitionBy("sid").orderBy("m"))
    drops = zero.withColumn("next", after).join(n, "sid")
    ok = (F.col("r0") != -1) & (F.col("next") != -1) & (F.col("r0") - F.col("next") > cfg.bound) & (F.col("m") <= F.col("mmax")) & ((F.col("m") < F.col("mmax")) | (F.col("mmax") > 1))
    found = drops.where(ok).groupBy("sid").agg(F.max(F.col("m") + 1).alias("found"))
    return n.join(found, "sid", "left").select("sid", F.coalesce("found", F.greatest(F.lit(1), F.col("mmax"))).alias("m"))


def embedding_dimension_legacy(series: DataFrame, tau: int | DataFrame, cfg: RqaConfig = RqaConfig(), dims: int = 1) -> DataFrame:
    """(sid, m) in the older form: mmax has no cap, thresholds of -1 (not found) are subtracted like any
    other, and m is -1 where no threshold drops by more than bound."""
    top = (3 * dims + 11) // 2
    after = F.lead("r0").over(W.partitionBy("sid").orderBy("m"))
    drops = fnn_zero_upto(series, tau, top + 1, cfg, dims, legacy=True).withColumn("drop", F.col("r0") - after)
    return drops.groupBy("sid").agg(F.coalesce(F.max(F.when(F.col("drop") > cfg.bound, F.col("m") + 1)), F.lit(-1)).alias("m"))


def rate_curve(embedded: DataFrame, cfg: RqaConfig = RqaConfig(), width: int | None = None) -> DataFrame:
    """(sid, k, rate): the recurrence rate at each radius epsmin + k * step of the grid that some
    pair reaches first; between those it stays the same."""
    d = recurrence.pair_distances(embedded, width, recurrence.TILE)
    step = (cfg.epsmax - cfg.epsmin) / (cfg.epsdiv - 1)
    # The first grid point above the distance, for which d < eps holds.
    k = F.greatest(F.lit(0), F.floor((F.col("d") - cfg.epsmin) / step) + 1).cast("int")
    counts = d.groupBy("sid", k.alias("k")).agg(F.count(F.lit(1)).alias("c")).where(F.col("k") < cfg.epsdiv)
    size = recurrence.sizes(embedded)
    first = size.select("sid", F.lit(1 if cfg.epsmin <= 0 else 0).alias("k"), F.lit(0).cast("long").alias("c"))
    counts = counts.union(first).groupBy("sid", "k").agg(F.sum("c").alias("c"))
    upto = W.partitionBy("sid").orderBy("k")
    return counts.join(size, "sid").select("sid", "k", ((2 * F.sum("c").over(upto) + F.col("n")) / (F.col("n").cast("double") * F.col("n"))).alias("rate"))


def radius(embedded: DataFrame, cfg: RqaConfig = RqaConfig(), width: int | None = None, sids: DataFrame | None = None) -> DataFrame:
    """(sid, eps): the least radius of the grid whose recurrence rate is within rr_delta of the
    target, else the middle of the grid; series of sids that have no states get 0.1."""
    step = (cfg.epsmax - cfg.epsmin) / (cfg.epsdiv - 1)
    curve = rate_curve(embedded, cfg, width)
    hit = curve.where(F.abs(F.col("rate") - cfg.target_rate) < cfg.rr_delta).where(cfg.epsmin + F.col("k") * step > 0)
    found = hit.groupBy("sid").agg(F.min("k").alias("k"))
    out = embedded.select("sid").distinct().join(found, "sid", "left").select("sid", F.coalesce(cfg.epsmin + F.col("k") * step, F.lit((cfg.epsmin + cfg.epsmax) / 2)).alias("eps"))
    return out if sids is None else sids.select("sid").distinct().join(out, "sid", "left").select("sid", F.coalesce("eps", F.lit(0.1)).alias("eps"))


def radius_legacy(embedded: DataFrame, cfg: RqaConfig = RqaConfig(), width: int | None = None) -> DataFrame:
    """(sid, eps) in the older form: the target is taken as it is, a radius of 0 may be found (nothing
    is nearer than 0, so its rate is 0), and eps is -1 where no radius of the grid fits."""
    step = (cfg.epsmax - cfg.epsmin) / (cfg.epsdiv - 1)
    curve = rate_curve(embedded, cfg, width)
    if cfg.epsmin <= 0:
        curve = curve.where("k > 0").union(embedded.select("sid").distinct().select("sid", F.lit(0), F.lit(0.0)))
    hit = curve.where(F.abs(F.col("rate") - cfg.reqrr) < cfg.rr_delta).groupBy("sid").agg(F.min("k").alias("k"))
    return embedded.select("sid").distinct().join(hit, "sid", "left").select("sid", F.coalesce(cfg.epsmin + F.col("k") * step, F.lit(-1.0)).alias("eps"))


def group_radius_joint(embedded: DataFrame, cfg: RqaConfig = RqaConfig(), width: int | None = None) -> DataFrame:
    """(eps): the least radius at which the mean rate of all series is within rr_delta of the target,
    or -1. One row; the curve has at most epsdiv points."""
    step = (cfg.epsmax - cfg.epsmin) / (cfg.epsdiv - 1)
    curve = rate_curve(embedded, cfg, width)
    jump = curve.withColumn("up", F.col("rate") - F.coalesce(F.lag("rate").over(W.partitionBy("sid").orderBy("k")), F.lit(0.0)))
    n = embedded.select("sid").distinct().agg(F.count(F.lit(1)).alias("series"))
    total = jump.groupBy("k").agg(F.sum("up").alias("up")).crossJoin(n)
    mean = total.select("k", (F.sum("up").over(W.orderBy("k")) / F.col("series")).alias("rate"))
    hit = mean.where((F.abs(F.col("rate") - cfg.target_rate) < cfg.rr_delta) & (cfg.epsmin + F.col("k") * step > 0))
    return hit.agg(F.coalesce(F.min(cfg.epsmin + F.col("k") * step), F.lit(-1.0)).alias("eps"))


def group_parameters(params: DataFrame) -> DataFrame:
    """(tau, m, eps) of a group: whole parts of the means of tau and m, the mean of positive eps or 0.1."""
    return params.agg(F.avg("tau").cast("int").alias("tau"), F.avg("m").cast("int").alias("m"), F.coalesce(F.avg(F.when(F.col("eps") > 0, F.col("eps"))), F.lit(0.1)).alias("eps"))
