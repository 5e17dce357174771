"""Connected components of a link table, by alternating large and small stars.

Every step is a minimum for each node and a join, so no component is ever gathered in one place and a node with very many
links is only a skewed join key. Links and labels stay in tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def starred(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (a, b) with a > b. Large star: the larger neighbours of each node are linked to its least neighbour (or
    itself); small star: the smaller neighbours, and the node itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = common.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "least")
    if large:  # (a, b) with a > b: a is a larger neighbour of b
        out = edges.join(least, F.col("b") == F.col("n")).select("a", F.col("m").alias("b"))
    else:
        out = edges.join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("m").alias("b")))
    return out.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def settled(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour at most, which has none itself."""
    roles = edges.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1").isEmpty()


def labels(links: DataFrame) -> DataFrame:
    """links (x, y) of any comparable type. Gives node and label, the least node that it is linked with, for every node
    that has a link; the labels' own nodes as well."""
    edges = common.stored(links.filter("x != y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
    while not settled(edges):
        edges = common.stored(starred(starred(edges, True), False), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
