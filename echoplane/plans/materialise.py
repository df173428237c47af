"""Cutting long plans where a stage's rows are used many times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys to at least four tasks a core. Small rows that are long work would else be put together, by
    their bytes, in a few tasks."""
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def materialised(df: DataFrame) -> DataFrame:
    """df, written to the cluster's shared checkpoint folder and read back. A temporary folder is taken
    where none is set and all runs in one process."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="echoplane-ckpt-"))
    return df.checkpoint()
