"""Connected components of a graph whose edges are a DataFrame.

Alternating large-star and small-star steps (Kiveris et al., Connected Components in MapReduce and
Beyond, 2014), until each component is a star around its least node. Every step is an aggregation with
map-side combination, whose result is written, and an equi-join of two written tables: with no
aggregation beside it, adaptive execution can split that join where a hub is hot. No edge reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
    made = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")), "edges")
    discard(edges, least)
    return made


def _small_star(edges: DataFrame) -> DataFrame:
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    made = written(moved.union(least).distinct(), "edges")
    discard(edges, least)
    return made


def _stars(edges: DataFrame) -> bool:
    """Whether each greater end has one edge and is no other edge's lesser end. Edges are distinct, with u > v."""
    several = edges.groupBy("u").count().where("count > 1").select("u")
    between = edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi")
    return several.union(between).isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns u, v); component is the smallest reachable node.

    Self-loops, null ends and repeated edges are ignored; without edges the result is empty.
    """
    now = written(
        edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    for _ in range(rounds):
        if _stars(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        now = _small_star(_large_star(now))
    raise RuntimeError(f"components did not converge within {rounds} rounds")
