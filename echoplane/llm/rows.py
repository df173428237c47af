"""Rows of a documents table as things to keep or drop: their names, and the first of each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import NULL_ID

#: What names a row: id with nulls last, text hash, hash of all columns.
ROW = ("_id", "_th", "_rh")


def named_rows(docs: DataFrame) -> DataFrame:
    """docs as (_row, text) with the columns of ROW."""
    text = F.col("text").cast("string")
    plain = [F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()]
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
        text.alias("text"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_id"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("_th"),
        F.xxhash64(*plain).alias("_rh"),
    )


def first_rows(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """docs with the first row, by ROW, of each _root of rooted (_root and ROW)."""
    first = rooted.groupBy("_root").agg(F.min(F.struct(*ROW)).alias("f")).select("f.*")
    left = named_rows(docs).drop("text").join(first, list(ROW), "left_semi")
    # Rows that are equal in all columns are told apart by nothing but their number.
    one = left.withColumn("_n", F.row_number().over(W.partitionBy(*ROW).orderBy("_id"))).where("_n = 1")
    return one.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
