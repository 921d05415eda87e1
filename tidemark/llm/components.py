"""Distributed union-find over an edge table: alternating large-star and small-star rounds.

After Kiveris et al., Connected Components in MapReduce and Beyond (2014). Only DataFrame
operations: each round is a partial aggregation and a join, with a reliable checkpoint between
rounds, and the driver sees nothing but two numbers a round. Where a caller says so, few edges are
joined in the driver instead, as rounds over many partitions cost more than they do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v) with u > v."""
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else pairs
    low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = both.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u != v").distinct()


def _labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges, and for each the smallest node reached."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while True:
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            return nodes, nodes[root]
        np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (root[root] != root).any():
            root = root[root]


def connected_components(edges: DataFrame, most_rounds: int = 60, here: int = 0) -> DataFrame:
    """(node, component) for every node that has an edge; component is the smallest node reached.

    ``edges`` has two columns of one orderable type. Self-loops and rows with a null are ignored;
    an empty table gives an empty one. Up to ``here`` edges (of longs) are joined in the driver.
    """
    a, b = edges.columns[:2]
    pairs = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull().alias("x"), F.col(b).isNotNull().alias("y")).where("x AND y AND u != v").select("u", "v").distinct())
    if here and pairs.count() <= here:
        few = pairs.toArrow()
        nodes, found = _labels(*(few.column(c).to_numpy() for c in ("u", "v")))
        return pairs.sparkSession.createDataFrame(pa.table({"node": nodes.astype(np.int64), "component": found.astype(np.int64)}), "node long, component long")
    before = None
    for _ in range(most_rounds):
        pairs = cut(_star(_star(pairs, True), False))
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
