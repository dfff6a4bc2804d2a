"""Connected components of an edge list by alternating large-star and small-star steps.

Each step is minimum aggregations, with map-side partial minima, and a join of
the links with one row a node, where adaptive execution splits a node with very
many neighbours over several tasks. Every round is checkpointed, which also cuts
lineage. Rounds grow with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.tables import checkpointed


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) links of longs in signed order -> (node, root), root the smallest node reachable; linked nodes only."""
    edge = checkpointed(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        large = _star(edge.union(edge.select(F.col("v").alias("u"), F.col("u").alias("v"))), larger=True)
        edge = checkpointed(_star(large, larger=False))
        state = edge.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == before:
            return edge.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edge.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _star(edge: DataFrame, larger: bool) -> DataFrame:
    """Link the larger (or the smaller and equal) neighbours of each u to the smallest node near it."""
    least = edge.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = edge.where("v > u") if larger else edge
    linked = near.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not larger:
        linked = linked.union(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()
