"""Connected components by alternating star contraction, all as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from actionloom.session import discard, stored

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    larger = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))  # a < b in both roles
    return larger.join(least, "a").filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a")
    return moved.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
        least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the smallest node reachable, for nodes that have an edge.

    Edges between equal or null nodes are ignored. Each round is written to the shared
    folder, so a lost executor costs one round at most.
    """
    # An edge points from its larger node a to its smaller node b.
    current = stored(edges.filter(f"{left} != {right}").select(
        F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
        wide = stored(_large_star(current).distinct())
        following = stored(_small_star(wide).distinct())
        discard(current, wide)
        current = following
    else:
        raise RuntimeError("components did not settle")
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
