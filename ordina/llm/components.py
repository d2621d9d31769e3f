"""Connected components by alternating large-star and small-star, on tables in the shared folder.

The edge list shrinks or keeps its size with every step, each step is an aggregation and an equi-join on the
node, and nothing of it reaches the driver but one number for each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = scratch.table(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """A node and its smaller neighbours are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = scratch.table(down.groupBy("u").agg(F.min("v").alias("m")))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge.  Loops and repeated edges don't matter; no edges give no rows."""
    edges = scratch.table(edges.select(F.greatest(u, v).cast("long").alias("u"), F.least(u, v).cast("long").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        big = scratch.table(_large_star(edges, scratch))
        small = scratch.table(_small_star(big, scratch))
        # a sum of hashes that no longer changes: stars only, each around its smallest node
        now = small.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(edges)
        scratch.drop(big)
        edges = small
        if now == before or not now["n"]:
            break
        before = now
    return scratch.table(edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct())
