"""Connected components of a table of links, by alternating large and small stars.

Every step is a minimum per node (with partial sums, so hubs are no hot task) and an equality join; the links are written to
the shared folder after each round. The number of rounds grows with the logarithm of the longest path.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.session import materialize


def _lowest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest of its neighbourhood."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).select("u", F.least("m", "u").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the smallest of them."""
    low = _lowest(links)
    moved = links.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def _stars_only(links: DataFrame) -> bool:
    """Whether every node either points to one other or is pointed to."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out > 1 OR out > 0 AND `in` > 0").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, component) of every node with a link (columns ``a`` and ``b``); a component is named by its smallest node.

    Nulls link nothing; loops and repeated links do no harm; no links give an empty table."""
    state = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = materialize(state, name)
    while not _stars_only(state):
        state = materialize(_small_star(_large_star(state)), name)
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(state.select("v", "v").distinct())
