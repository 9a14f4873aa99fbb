"""Distributed union-find: connected components by alternating stars, DataFrames only.

Large-star hooks every larger neighbour of a node to the least of its
neighbourhood, small-star the smaller ones; rounds go on until all edges lead
from a node to its component's least node. The edges of each round are cut from
their lineage by a reliable checkpoint; nothing but two counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recoflow.llm.common import checkpointed

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b), in any order and with repeats -> (node, root) for nodes that have an edge.

    root is the least node of the component and has no row of its own; loops and
    edges with a null end are left out; no edge, no row.
    """
    e = checkpointed(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
                     .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(ROUNDS):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # every edge now leads down; a node's smaller neighbours and itself go to the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u")
        e = checkpointed(small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
                         .union(down.select("u", F.col("m").alias("v"))).distinct())
        # done when each node has one edge and no root has an edge of its own
        state = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        open_roots = e.select(F.col("v").alias("u")).distinct().join(state, "u", "left_semi").limit(1).count()
        if not open_roots and not state.where("n > 1").limit(1).count():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
