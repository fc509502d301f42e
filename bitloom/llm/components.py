"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import checkpoint


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: bigint) that is not the smallest of its component.

    root is the smallest node that the node can reach. Each round joins the edges with the
    smallest neighbour of each node, found by a pre-aggregated grouping, and is checkpointed twice;
    rounds end when all that is left are stars, and only the number of nodes that are in none comes
    back. Self-links and repeated edges do no harm; no edges give no rows.
    """
    now = checkpoint(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while _unsettled(now):
        both = now.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = checkpoint(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        # The neighbours of a node, and in the row of the least of them the node itself.
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _unsettled(edges: DataFrame) -> int:
    """The number of nodes that have two smaller neighbours or both a smaller and a larger one."""
    one, none = F.lit(1).alias("below"), F.lit(0).alias("below")
    ends = edges.select(F.inline(F.array(F.struct(F.col("u").alias("node"), one), F.struct(F.col("v").alias("node"), none))))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count("*").alias("all"))
    return nodes.where("below > 1 or below = 1 and all > 1").count()
