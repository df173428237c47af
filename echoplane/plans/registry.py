"""Registry of the queries: name -> (spark, sf_dir) -> DataFrame, with DuckDB oracles, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import embed, series
from ..sources import series as sources

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Whole numbers as long, doubles rounded to six places and without negative zero."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType | T.FloatType | T.DecimalType):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif isinstance(f.dataType, T.IntegerType | T.ShortType | T.LongType):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = lambda spark, sf_dir: tidy(f(spark, sf_dir))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


def z(spark, d) -> DataFrame:
    return series.zscore(sources.ev_user(spark, d))


def z2(spark, d) -> DataFrame:
    return series.zscore(sources.ev_user2(spark, d), 2)


def embedded(spark, d) -> DataFrame:
    return embed.delay_embed(z(spark, d), 1, 2)


def flat(df: DataFrame, *names: str, keys: tuple[str, ...] = ("sid", "t")) -> DataFrame:
    """x as columns of its own."""
    return df.select(*keys, *(F.col("x")[k].alias(n) for k, n in enumerate(names)))


def points(spark, d) -> DataFrame:
    """(id, label, features) of the embeddings."""
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("features"))
