"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.shared import materialise


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): each u's least neighbour, combined before the shuffle; a star's edges meet it in a join, whose hot partitions the adaptive planner splits."""
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.where("v > u").join(_least(both), "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.join(_least(down), "u")
    return low.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the component's least node.

    edges has the long columns u and v. Self-loops and repeated edges change nothing, an
    empty table gives an empty one. Rounds grow with the logarithm of a component's width;
    each ends in a reliable checkpoint, so a lost executor costs one round at most.
    """
    now = materialise(edges.where("u != v").select("u", "v").distinct())
    seen = None
    while True:
        stats = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.max(F.struct("u", "v"))).first()
        if stats == seen or stats[0] == 0:
            break
        seen = stats
        now = materialise(_small_star(_large_star(now)))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
