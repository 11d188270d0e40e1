"""Connected components of a large set of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotemill.session import staged


# Links in one file; few links are written as one file, not as one for each shuffle partition.
LINKS_PER_FILE = 100_000


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest node reachable from each linked node: ``(node, component)`` from long columns ``a, b``.

    Alternates two steps: every node hands its larger neighbours to its smallest neighbour, then its smaller
    ones. Neither makes more links than there were, and a hub only gets smaller neighbours, so no task holds
    a node's links at once. The links become stars around the smallest nodes in about as many rounds as the
    logarithm of the longest path; links that are such stars take none. Nodes without links to others, and links
    with a null end, have no row.
    """
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links"
    )
    files = edges.count() // LINKS_PER_FILE + 1
    while not _are_stars(edges):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        larger = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # The smallest neighbour of a node is linked to the node itself as well.
        kept = least.filter("m < u").select("u", F.col("m").alias("v"))
        large = staged(larger.union(kept).filter("u <> v").distinct().coalesce(files), "links")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(smaller.union(least.select("u", F.col("m").alias("v"))).distinct().coalesce(files), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _are_stars(edges: DataFrame) -> bool:
    """Whether every larger end ``u`` has one link, to a node ``v`` without links to smaller ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select("v", F.lit(0)))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return nodes.filter("up > 1 or (up = 1 and n > 1)").isEmpty()


def joined_components(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``connected_components`` of the links that made ``groups`` and further ones, which only join whole groups."""
    for end in ("a", "b"):
        roots = groups.select(F.col("node").alias(end), "component")
        links = links.join(roots, end, "left").withColumn(end, F.coalesce("component", end)).drop("component")
    found = connected_components(links)
    into = found.select(F.col("node").alias("component"), F.col("component").alias("into"))
    moved = groups.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return moved.union(found.join(groups, "node", "left_anti"))
