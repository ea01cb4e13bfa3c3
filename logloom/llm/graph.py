"""Connected components by alternating large-star and small-star joins.

Every step is a partial aggregation and an equality join on the node, so a node with very many
neighbours is a skewed join that adaptive execution splits. Components and links stay in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _digest(edges: DataFrame) -> tuple:
    """Number of edges and a checksum, to see when a round changed nothing."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
    return moved.union(low.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (a, b), both of one orderable type.

    root is the smallest node that can be reached. Self-links and repeated links are allowed, null
    ends are ignored, and an empty table gives an empty one.
    """
    edges = written(edges.select("a", "b").dropna().filter("a != b").distinct(), "edges")
    seen = _digest(edges)
    for _ in range(max_rounds):
        edges = written(_small_star(_large_star(edges)), "edges")
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
