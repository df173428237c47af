"""Sources and sinks of series tables: (sid, t, x) with x an array of one double per channel."""

from __future__ import annotations

import io
import json
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCHEMA = "sid string, t int, x array<double>"


def from_rows(rows: DataFrame, sid: str | Column, order: list[str | Column], channels: list[str | Column]) -> DataFrame:
    """A table of samples as a series table: t counts each sid's rows in the given order."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    kept = rows.select(col(sid).alias("sid"), *(col(c).alias(f"_o{k}") for k, c in enumerate(order)), F.array(*(col(c).cast("double") for c in channels)).alias("x"))
    w = W.partitionBy("sid").orderBy(*(f"_o{k}" for k in range(len(order))))
    return kept.select("sid", (F.row_number().over(w) - 1).alias("t"), "x")


def ev_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values in order of time."""
    return from_rows(spark.read.parquet(f"{sf_dir}/events.parquet"), "user_id", ["ts", "event_id"], ["value"])


def ev_user2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values and the seconds since the event before."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", "value")
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(w)
    return from_rows(events.withColumn("gap", gap / 1e6).where("gap is not null"), "user_id", ["ts", "event_id"], ["value", "gap"])


def ev_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series of daily sums, a channel for each type of event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    types = sorted(r[0] for r in events.select("event_type").distinct().collect())
    days = events.groupBy(F.to_date("ts").alias("day")).pivot("event_type", types).agg(F.sum("value"))
    return from_rows(days, F.lit(0).cast("long"), ["day"], [F.coalesce(F.col(f"`{t}`"), F.lit(0.0)) for t in types])


def ord_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series: the total price of each day's orders."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    days = orders.groupBy("o_orderdate").agg(F.sum(F.col("o_totalprice").cast("decimal(20,4)")).cast("double").alias("v"))
    return from_rows(days, F.lit(0).cast("long"), ["o_orderdate"], ["v"])


def emb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a series along its positions."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("sid"), F.posexplode("embedding").alias("t", "v")).select("sid", "t", F.array(F.col("v").cast("double")).alias("x"))


def from_arrays(spark: SparkSession, signals: Iterable, ids: Iterable[str] | None = None) -> DataFrame:
    """Arrays (n,) or (n, channels) as a series table; ids default to signal_<k>."""
    rows = []
    for k, s in enumerate(signals):
        a = np.asarray(s, dtype=float)
        if a.ndim == 0:
            raise ValueError("a signal must have one or two dimensions")
        a = a.reshape(len(a), -1)
        rows.append((k, a))
    names = list(ids) if ids is not None else [f"signal_{k}" for k, _ in rows]
    if len(names) != len(rows):
        raise ValueError("ids must name each signal")
    return spark.createDataFrame([(str(n), t, v.tolist()) for n, (_, a) in zip(names, rows) for t, v in enumerate(a)], SCHEMA)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """All .npy files below a directory; sid is the file's name. Read by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path)

    def load(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = np.atleast_1d(a).reshape(len(np.atleast_1d(a)), -1).astype(float)
                yield pd.DataFrame({"sid": name.rsplit("/", 1)[-1], "t": np.arange(len(a), dtype=np.int32), "x": list(a)})

    return files.select("path", "content").mapInPandas(load, SCHEMA)


def read_csv(spark: SparkSession, path: str, sid: str, order: list[str], channels: list[str]) -> DataFrame:
    """A CSV table of samples with a header as a series table."""
    return from_rows(spark.read.csv(path, header=True, inferSchema=True), sid, order, channels)


def load_signals(spark: SparkSession, source) -> DataFrame:
    """A directory of .npy files, an array, or a list or tuple of arrays as a series table."""
    if isinstance(source, str):
        found = read_npy(spark, source)
        if found.isEmpty():
            raise ValueError(f"no .npy files in {source}")
        return found
    if isinstance(source, np.ndarray):
        return from_arrays(spark, [source])
    if isinstance(source, list | tuple):
        return from_arrays(spark, source)
    raise TypeError("signals must be a directory, an array, or a list of arrays")


def labels_from_ids(ids: DataFrame, pattern: str = "-") -> DataFrame:
    """(sid, label): the text of the id before the first separator."""
    return ids.select("sid", F.split(F.col("sid").cast("string"), pattern, 2)[0].alias("label")).distinct()


def parse_tuple_ids(ids: DataFrame, names: list[str]) -> DataFrame:
    """Ids that are written as tuples, such as "('a', 1, 0.5)", as columns of strings."""
    bare = F.split(F.regexp_replace(F.col("sid").cast("string"), r"[()'\"\s]|\.npy$", ""), ",")
    return ids.select("sid", *(bare[k].alias(n) for k, n in enumerate(names)))


def errors(series: DataFrame, least: int = 10) -> DataFrame:
    """(sid, error): series that an analysis refuses."""
    n = series.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.sum(F.exists("x", lambda v: v.isNull() | F.isnan(v)).cast("int")).alias("bad"))
    told = F.when(F.col("n") < least, F.lit(f"fewer than {least} samples")).when(F.col("bad") > 0, F.lit("missing values"))
    return n.select("sid", told.alias("error")).where("error is not null")


def save_results(tables: dict[str, DataFrame], config: dict, path: str) -> None:
    """Writes each table as Parquet below path, and the configuration as JSON."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(config), ",".join(tables))], "config string, tables string").coalesce(1).write.mode("overwrite").json(f"{path}/_config")


def load_results(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    """What `save_results` wrote."""
    row = spark.read.schema("config string, tables string").json(f"{path}/_config").first()
    return {n: spark.read.parquet(f"{path}/{n}") for n in row.tables.split(",")}, json.loads(row.config)
