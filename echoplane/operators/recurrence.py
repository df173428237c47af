"""Pairs of near states. Pair tables are sparse: a row for each recurrent pair i > j.

The join is an equi-join on sid with the distance as a residual predicate. One task
would hold all pairs of a long series, so the later states of a pair meet the earlier ones
tile by tile: the join key is then (sid, tile of B consecutive times), a task holds one tile
and streams the states that follow it. Radius-bound joins may add cells of the first
coordinate, for states nearer than eps differ by less than eps in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(width: int | None, a: str = "ea", b: str = "eb", metric: str = "euclidean") -> Column:
    """Distance of two arrays of doubles; spelled out (and compiled) where width is known."""
    if width:
        d = [F.col(a)[k] - F.col(b)[k] for k in range(width)]
        if metric == "euclidean":
            total = d[0] * d[0]
            for x in d[1:]:
                total = total + x * x
            return F.sqrt(total)
        if metric == "chebyshev":
            return F.greatest(*map(F.abs, d)) if width > 1 else F.abs(d[0])
        total = F.abs(d[0])
        for x in d[1:]:
            total = total + F.abs(x)
        return total
    if metric == "euclidean":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    diff = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.array_max(diff) if metric == "chebyshev" else F.aggregate(diff, F.lit(0.0), lambda s, x: s + x)


#: Consecutive times in a tile, where pairs are reduced right after the join.
TILE = 512
#: Samples from which on a series is too long for one task to hold all its pairs.
LONG = 4096


def longest(series: DataFrame) -> int:
    """Samples of the longest series."""
    return series.groupBy("sid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def tile_of(samples: int) -> int | None:
    """TILE if the longest series has more than LONG samples, else None: then one task a series saves an exchange."""
    return TILE if samples > LONG else None


def tile_for(series: DataFrame) -> int | None:
    return tile_of(longest(series))


def _met(later: DataFrame, earlier: DataFrame, keys: tuple[str, ...], tile: int | None, both: bool = False) -> DataFrame:
    """later (keys, i, ..) joined with earlier (keys, j, ..); rows with i < j are left to the caller to drop.
    With both, states meet all others, before and after them."""
    if not tile:
        return later.join(earlier, list(keys))
    last = F.floor(F.col("i") / tile).cast("int")
    if both:
        later = later.join(earlier.groupBy(*keys).agg(F.floor(F.max("j") / tile).cast("int").alias("_last")), list(keys))
        last = F.col("_last")
    later = later.withColumn("_q", F.explode(F.sequence(F.lit(0), last)))
    return later.join(earlier.withColumn("_q", F.floor(F.col("j") / tile).cast("int")), [*keys, "_q"])


def pair_distances(embedded: DataFrame, width: int | None = None, tile: int | None = None, metric: str = "euclidean", keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, i, j, d) for all pairs i > j of each series."""
    a = embedded.select(*keys, F.col("t").alias("i"), F.col("e").alias("ea"))
    b = embedded.select(*keys, F.col("t").alias("j"), F.col("e").alias("eb"))
    return _met(a, b, keys, tile).where("i > j").select(*keys, "i", "j", distance(width, metric=metric).alias("d"))


def recurrence_pairs(embedded: DataFrame, eps: float | DataFrame, width: int | None = None, tile: int | None = None, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, i, j): pairs i > j nearer than eps, which may be a table (sid, eps)."""
    return recurrent_places(embedded, eps, width, tile, keys).where("i > j")


def recurrent_places(embedded: DataFrame, eps: float | DataFrame, width: int | None = None, tile: int | None = None, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, i, j): as `recurrence_pairs`, with the main diagonal: all that a plot's lower half has."""
    own = embedded.join(eps.select(*keys, "eps"), list(keys)) if isinstance(eps, DataFrame) else embedded.withColumn("eps", F.lit(float(eps)))
    a = own.select(*keys, F.col("t").alias("i"), F.col("e").alias("ea"), "eps")
    b = embedded.select(*keys, F.col("t").alias("j"), F.col("e").alias("eb"))
    return _met(a, b, keys, tile).where("i >= j").where(distance(width) < F.col("eps")).select(*keys, "i", "j")


def recurrence_pairs_by_cell(embedded: DataFrame, eps: float, width: int | None = None) -> DataFrame:
    """The same pairs, by cells of width eps along the first coordinate: a state meets its own and
    the next lower and higher cell only."""
    cell = F.floor(F.col("e")[0] / eps)
    a = embedded.select("sid", F.col("t").alias("i"), F.col("e").alias("ea"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_c"))
    b = embedded.select("sid", F.col("t").alias("j"), F.col("e").alias("eb"), cell.alias("_c"))
    return a.join(b, ["sid", "_c"]).where("i > j").where(distance(width) < eps).select("sid", "i", "j")


def mirrored(pairs: DataFrame, embedded: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """The whole plot: pairs, their mirror images and the main diagonal."""
    swapped = pairs.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"))
    return pairs.union(swapped).union(embedded.select(*keys, F.col("t").alias("i"), F.col("t").alias("j")))


def sizes(embedded: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, n): the plot's side."""
    return embedded.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("n"))


def recurrence_rate(pairs: DataFrame, size: DataFrame, keys: tuple[str, ...] = ("sid",)) -> DataFrame:
    """(sid, recurrence_rate): the plot's share of ones, its main diagonal included."""
    counted = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    rate = (2 * F.coalesce("c", F.lit(0)) + F.col("n")) / (F.col("n").cast("double") * F.col("n"))
    return size.join(counted, list(keys), "left").select(*keys, rate.alias("recurrence_rate"))


def nearest_neighbours(embedded: DataFrame, width: int | None = None, tile: int | None = TILE) -> DataFrame:
    """(sid, t, nn, d): each state's nearest other state; ties take the earliest. The least distance
    of each state first, then the first place that has it: both are plain minima, which partial
    aggregation keeps next to the join, so pairs are never shuffled."""
    b = embedded.select("sid", F.col("t").alias("j"), F.col("e").alias("eb"))

    def met(a: DataFrame) -> DataFrame:
        return _met(a, b, ("sid",), tile, both=True).where("i <> j").withColumn("d", distance(width))

    a = embedded.select("sid", F.col("t").alias("i"), F.col("e").alias("ea"))
    least = met(a).groupBy("sid", "i").agg(F.min("d").alias("least"))
    at = met(a.join(least, ["sid", "i"])).groupBy("sid", "i").agg(F.min(F.when(F.col("d") == F.col("least"), F.col("j"))).alias("nn"), F.min("d").alias("d"))
    return at.select("sid", F.col("i").alias("t"), "nn", "d")


def nearest_neighbours_legacy(embedded: DataFrame, tau: int, width: int | None = None) -> DataFrame:
    """(sid, t, nn, d) in the older form: only states with one more sample tau later take part, and of
    several nearest states t = 0 takes the last one if that is among them; a state alone is its own."""
    part = embedded.join(embedded.groupBy("sid").agg((F.max("t") - tau).alias("_end")), "sid").where(F.col("t") <= F.col("_end")).drop("_end")
    ends = part.groupBy("sid").agg(F.max("t").alias("_last"), F.min_by("e", "t").alias("_e0"), F.max_by("e", "t").alias("_e1"))
    ends = ends.select("sid", "_last", distance(width, "_e0", "_e1").alias("_d"))
    near = part.select("sid", "t").join(nearest_neighbours(part, width), ["sid", "t"], "left").join(ends, "sid")
    last = (F.col("t") == 0) & ((F.col("_d") <= F.col("d")) | (F.col("_last") == 0))
    return near.select("sid", "t", F.when(last, F.col("_last")).otherwise(F.col("nn")).alias("nn"), F.coalesce("d", F.lit(0.0)).alias("d"))


def submatrix(plot: DataFrame, i: int, j: int, window: int) -> DataFrame:
    """The window x window part of the plot that begins at (i, j)."""
    return plot.where(F.col("i").between(i, i + window - 1) & F.col("j").between(j, j + window - 1))
