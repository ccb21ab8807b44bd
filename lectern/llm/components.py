"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def _settled(edges: DataFrame) -> bool:
    """Are these stars: no node with two parents, or with a parent and a child?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("k")).where("k > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component, for every node that isn't its own root.  ``edges``: a, b long."""
    edges = cut(edges.where("a <> b").select("a", "b"), "edges")
    while True:
        edges = cut(_small_star(_large_star(edges)), "stars")
        if _settled(edges):
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
