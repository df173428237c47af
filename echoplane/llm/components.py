"""Connected components of a graph held as a table of edges, without gathering it anywhere.

Partitions first join up what their own edges connect. Where at most FEW edges are left,
one task joins those up. Else each round joins up within partitions again and
alternates large-star and small-star steps (minimum over neighbours, then a join): each
node's edges move to smaller nodes until every component is a star around its smallest
node. Minima are combined before the shuffle and the joins leave skewed keys to Spark's
skew-join handling, so a node with very many edges is no bottleneck.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut

#: Edges that a task joins up at a time.
BLOCK = 1 << 20
#: So few stars that one task joins them all up: 16 MB.
FEW = 1 << 20


def local_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of the edges as stars: (node, smallest node), without the smallest itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        for x in (label[a], label[b], a, b):
            np.minimum.at(label, x, low)
        while not np.array_equal(label, up := label[label]):
            label = up
        if np.array_equal(label, before):
            break
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v, size = [], [], 0

    def out():
        a, b = local_stars(np.concatenate(u), np.concatenate(v))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["u", "v"])

    for batch in batches:
        u.append(batch.column(0).to_numpy())
        v.append(batch.column(1).to_numpy())
        size += batch.num_rows
        if size >= BLOCK:
            yield out()
            u, v, size = [], [], 0
    if size:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v), both long -> (node, component): the smallest node that each node reaches.
    Nodes that are the smallest of their own component are not listed."""
    schema = "u long, v long"
    e = cut(edges.mapInArrow(_contract, schema).distinct())
    if e.count() <= FEW:
        return e.coalesce(1).mapInArrow(_contract, schema).toDF("node", "component")
    while True:
        # Large star: what is linked to a larger neighbour gets that neighbour a link to its minimum.
        both = e.union(e.select("v", "u")).toDF("a", "b")
        least = cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m")))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        e = cut(e.mapInArrow(_contract, schema).distinct())
        # Small star: a node's smaller neighbours, and itself, go to the least of them.
        least = cut(e.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        several = least.where("n > 1")
        if several.isEmpty() and e.select("u").join(e.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        small = e.join(least.select("u", "m"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(least.select("u", F.col("m").alias("v"))).mapInArrow(_contract, schema).distinct())
