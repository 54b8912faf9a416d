"""Connected components by alternating large-star and small-star rounds of joins (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: More than any graph of 2^64 nodes needs; reaching it is an error, not a result.
MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(low, "a")
    return (moved.select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(moved.select("a", F.col("m").alias("b"))).filter("a <> b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): every node that has a link, with the smallest node it can reach.

    Rows are pre-aggregated before each shuffle; a round's edges are checkpointed, and rounds stop when the
    edges no longer change.
    """
    now = checkpoint(_small_star(edges.select("a", "b").distinct()))
    seen = None
    for _ in range(MAX_ROUNDS):
        now = checkpoint(_small_star(_large_star(now)))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        seen = tuple(state)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
