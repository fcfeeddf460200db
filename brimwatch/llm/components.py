"""Connected components of a graph whose edges never leave the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brimwatch.llm.common import stage, unstage


def _state(edges: DataFrame) -> tuple:
    """Two numbers that change when the set of edges does."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); root is the smallest node.

    Alternates two steps: every node hands its larger neighbours to the smallest
    one it knows (large star), then its smaller ones (small star). Both are a
    minimum per node, combined before the shuffle, and a join; a node with very
    many neighbours is split by the skew join. The number of rounds grows with the
    logarithm of the longest chain. Null ends and loops are ignored.
    """
    plain = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = stage(
        plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    seen = _state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stage(large, "links")
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a")
            .where("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(lowest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        after = stage(small, "links")
        state = _state(after)
        unstage(now, large)
        now = after
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
