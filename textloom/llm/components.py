"""Connected components by alternating large-star and small-star steps, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node points at one other, which points at none."""
    n = edges.agg(F.count("*").alias("n"), F.count_distinct("u").alias("u")).first()
    return n.n == n.u and edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (node, component) for every node of ``links``; a component is named by its smallest node.

    Self-links count as nodes, repeated links as one, and links with a null are left out. Each step groups by a node
    with a minimum only, which combines before the shuffle; the join that follows has one row per node on one side, so
    a hub with a third of all links is split by adaptive execution. Nothing but counts comes to the driver. Each step's edges are written to the shared folder.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = cut(ends.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    edges = edges.where("u != v")
    while not _are_stars(edges):
        # large star: what is larger than a node moves to the smallest neighbour, the node itself included
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its smaller neighbours move to the smallest of them
        edges = cut(large.where("u != v").distinct())
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")))
        small = edges.join(least, "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        edges = cut(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u != v").distinct())
    return nodes.join(edges.select(F.col("u").alias("node"), F.col("v").alias("least")), "node", "left").select("node", F.coalesce("least", "node").alias("component"))
