"""Connected components of an edge table: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from specmatch.session import cut


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(a, b) pairs in, (node, component) out; a component is named by its smallest node.

    Edges point from the larger node to the smaller one. Large star: an edge to b becomes one to the least neighbour of b. Small star:
    all smaller neighbours of a node are tied to the least of them. Each node's least neighbour is written down before it is joined, so
    that both sides of the join come straight from an exchange: Spark sends the smaller one to all tasks where its size allows, and splits the
    partition of a node with very many neighbours where not. A round ends when no edge moved. Self-loops and repeated or reversed
    edges are harmless; nodes without an edge are not returned; lineage is cut in the shared folder.
    """
    now = cut(edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    least = cut(now.groupBy("a").agg(F.min("b").alias("m")))
    for _ in range(rounds):
        up = least.select(F.col("a").alias("b"), F.col("m").alias("_up"))
        large = cut(now.join(up, "b", "left").select("a", F.coalesce("_up", "b").alias("b"), F.col("_up").isNotNull().alias("moved")).groupBy("a", "b").agg(F.max("moved").alias("moved")))
        least = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.max("moved").alias("moved"), F.count("*").alias("n")))
        if not least.where("moved OR n > 1").limit(1).count():
            break
        extra = large.drop("moved").join(least.select("a", "m"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = cut(extra.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        least = cut(now.groupBy("a").agg(F.min("b").alias("m")))
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = least.select(F.col("a").alias("node"), F.col("m").alias("component"))
    return stars.unionByName(least.select(F.col("m").alias("node"), F.col("m").alias("component")).distinct())
