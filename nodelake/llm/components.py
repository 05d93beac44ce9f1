"""Connected components by alternating large-star and small-star steps (joins and sums only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodelake.session import stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0])


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node reachable, for every node of ``edges`` (a, b: longs).

    Large star: each node's larger neighbours are linked to the least node about it. Small star: its
    smaller neighbours and itself are. No neighbour list is ever gathered; the number of rounds grows
    with the logarithm of the longest chain.
    """
    least = lambda e: e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(least(both), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        m = least(large)
        small = large.join(m, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(m.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a <> b").distinct(), "links")
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
