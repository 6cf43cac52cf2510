"""Connected components of an undirected graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes with an edge; component is the smallest node. edges has longs a and b.

    Stars are rewired until nothing changes (a number of rounds in the order of log n); minima are pre-aggregated, and a hub is
    one side of a join that can be split.
    """
    now = stored(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while True:
        now = stored(_small_star(stored(_large_star(now), "edges")), "edges")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == before:
            break
        before = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b")).distinct()
