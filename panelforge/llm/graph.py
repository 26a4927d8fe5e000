"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge import session


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one link to a smaller one at most, and none that has also ends a link."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per_node.where((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b); root is the least node of its component.

    Large-star and small-star steps alternate: each node hands its larger, then its smaller, neighbours to the least
    node around it, until the links are stars.  Minima are pre-aggregated, and a hot node's links are joined to its
    minimum, so no neighbourhood is gathered.  Every round is written to the shared folder.
    """
    edges = session.materialize(links.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _are_stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = session.materialize(large.where("a <> b"), "large_star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).union(small.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")))
        edges = session.materialize(small.where("a <> b").distinct(), "small_star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
