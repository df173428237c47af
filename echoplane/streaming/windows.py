"""Recurrence rates of event streams. The stateful part keeps, for each key, the latest states only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_windows(events: DataFrame, key: str, time: str, value: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(key, start, n, mean, std) of tumbling or sliding windows of event time, with a watermark."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, late).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(key, F.col("w.start").alias("start"), "n", "mean", "std")


def sliding_rates(events: DataFrame, key: str, time: str, value: str, size: int = 20, step: int = 10, eps: float = 0.5) -> DataFrame:
    """(key, window, recurrence_rate) of every window of size samples, step apart, of each key's
    stream. The state is at most size samples a key."""
    kind = events.schema[key].dataType.simpleString()

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = state.get if state.exists else ([], 0)
        held, rows = list(held), []
        new = pd.concat(list(batches)).sort_values(time)[value].tolist()
        for v in new:
            held.append(float(v))
            if len(held) == size:
                x = np.array(held)
                sd = x.std() + 1e-10
                rows.append((k[0], done, float((np.abs(x[:, None] - x) / sd < eps).mean())))
                done += 1
                held = held[step:]
        state.update((held, done))
        yield pd.DataFrame(rows, columns=[key, "window", "recurrence_rate"])

    picked = events.select(key, time, value)
    return picked.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, window long, recurrence_rate double", "held array<double>, done long", "append", GroupStateTimeout.NoTimeout)
