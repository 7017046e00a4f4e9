"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentinela.llm.common import stored


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node points to one node at most and no node that is pointed to points on."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    degrees = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return degrees.filter("out > 1 or (out > 0 and into > 0)").isEmpty()


def components(links: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, label) for every node of `links` (a, b), both bigint; label is the smallest node reachable.

    Each step sends the neighbours of a node to the smallest of them, and takes one aggregate and one join, so a node with
    very many links is combined on the map side and split by the adaptive skew join. Self-links and repeated links are
    allowed, links with a null end are ignored, and an empty table gives an empty one. The table is written after each step
    pair, in `parts` files at most; steps end when every node points to its label, after a number of rounds that grows with
    the logarithm of the nodes.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, parts)
    while not _is_forest(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), parts)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
