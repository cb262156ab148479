"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlake.session import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes with a link to another; the component is its smallest node.

    Each round hangs the neighbours of a node on the smallest of them: the larger ones first, then the smaller. Rounds
    grow with the logarithm of the longest chain. Links of a node are aggregated, never gathered; rounds are written, so
    a lost executor costs one round at most.
    """
    # edges are small rows: a few tasks per core are enough for them
    tasks = 4 * links.sparkSession.sparkContext.defaultParallelism
    cut = lambda df: cut_lineage(df.coalesce(tasks))
    edges = cut(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """True when every node hangs on one smaller node that hangs on none."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("low")), F.struct(F.col("v").alias("node"), F.lit(0).alias("low")))).alias("e"))
    nodes = ends.select("e.*").groupBy("node").agg(F.sum("low").alias("hangs"), F.max(1 - F.col("low")).alias("holds"))
    return nodes.filter((F.col("hangs") > 1) | ((F.col("hangs") > 0) & (F.col("holds") > 0))).isEmpty()
