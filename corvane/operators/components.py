"""Connected components of links, by alternating large-star and small-star steps.

Each step replaces a node's links by links to the smallest node that it knows, until every node is
linked with its component's smallest alone. A node's links are only reduced to their least and
joined back, so the centre of a large star is never gathered. Rounds grow with the logarithm of the
longest path; each is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.checkpoint import checkpointed
from .joins import sorted_join


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    least = checkpointed(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")), "least")
    return sorted_join(both, least, "u").filter("v > u and v <> least").select(F.col("least").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = checkpointed(edges.groupBy("b").agg(F.min("a").alias("least")), "least")
    moved = sorted_join(edges, least, "b").filter("a <> least").select(F.col("least").alias("a"), F.col("a").alias("b"))
    return moved.union(least.select(F.col("least").alias("a"), "b"))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes of links (a, b); links of a node to itself don't count."""
    edges = links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = checkpointed(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        edges = checkpointed(_small_star(checkpointed(_large_star(edges).distinct(), "large")).distinct(), "small")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    roots = edges.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return checkpointed(edges.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(roots), "components")
