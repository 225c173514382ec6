"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every left end has one edge and is no right end: then stars are components."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("centre")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("centre"))
    )
    roles = ends.groupBy("node").agg(F.sum("child").alias("child"), F.max("centre").alias("centre"))
    return roles.where((F.col("child") > 1) | ((F.col("child") == 1) & (F.col("centre") == 1))).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links(u, v)`` that is not its own
    component's smallest node.

    A hub is met through an aggregate and a join, so no task gathers its neighbours. The
    rounds end when the links are stars; they grow with the logarithm of the longest chain.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while not _are_stars(edges):
        large = cut(_large_star(edges), "links")
        old, edges = edges, cut(_small_star(large), "links")
        release(old)
        release(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
