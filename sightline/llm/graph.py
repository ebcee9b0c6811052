"""Connected components of a table of links, by alternating large and small stars; no key's links are gathered."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_from, lookup_join, written


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """edges (a, b) with a > b, `total` rows at most. Links each node's larger (or smaller) neighbours and itself to its least neighbour."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    met = lookup_join(both, least.select("u", "m"), "u", least.where(F.col("n") >= heavy_from(total)).select("u"))
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b): returns (node, component) for every linked node; the component is its smallest node."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links", small=True)
    while True:  # the number of rounds grows with the logarithm of the longest path
        total, worst = _roles(edges)
        if worst <= 1:
            break
        edges = written(_star(_star(edges, True, total), False, total), "stars", small=True)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _roles(edges: DataFrame) -> tuple[int, int]:
    """Number of edges, and the most roles a node has: each parent of a child counts, and being a parent counts once.

    One at most means that every node is only a parent, or only the child of one: then parents are the components' least nodes.
    """
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
    roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    found = roles.agg(F.sum("child").alias("total"), F.max(F.col("child") + F.col("parent")).alias("worst")).first()
    return found.total or 0, found.worst or 0
