"""Delay embedding: (sid, t, e) with e the m delayed samples of all channels, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import in_time


def delay_embed(series: DataFrame, tau: int = 1, m: int = 1) -> DataFrame:
    """The same tau and m for all series. Series of (m - 1) * tau samples or fewer have no rows."""
    if tau < 1 or m < 1:
        raise ValueError("tau and m must be positive")
    later = [F.lead("x", k * tau).over(in_time()) for k in range(1, m)]
    out = series.select("sid", "t", F.flatten(F.array("x", *later)).alias("e"))
    return out.where("e is not null")


def delay_embed_by(series: DataFrame, params: DataFrame) -> DataFrame:
    """tau and m by series, from params (sid, tau, m). A series travels as one array here."""
    whole = series.groupBy("sid").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "x"))), lambda s: s["x"]).alias("s"))
    n = "size(s) - (m - 1) * tau"
    at = f"case when {n} > 0 then sequence(0, {n} - 1) else cast(array() as array<int>) end"
    rows = whole.join(params.select("sid", "tau", "m"), "sid").select("sid", F.expr(f"inline(transform({at}, i -> struct(i as t, flatten(transform(sequence(0, m - 1), k -> s[i + k * tau])) as e)))"))
    return rows


def embedded_length(n: int, tau: int, m: int) -> int:
    return max(0, n - (m - 1) * tau)
