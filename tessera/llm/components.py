"""Connected components of links that stay distributed: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_table


#: Up to so many links are handled by one task a step, which saves the exchanges.
ONE_TASK = 1_000_000


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each larger neighbour of a node is linked to the smallest of the node and its neighbours. Small: the node and its smaller neighbours are."""
    around = _both(edges) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = around.join(least, "u")
    if large:
        linked = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """node and comp (the smallest node that it reaches) for every node of the links (u, v); nodes without links don't appear.

    Each step's links are written to the shared folder. The steps grow with the logarithm of the largest component."""
    edges = shared_table(edges.where("u <> v").distinct(), "links")
    before = _sum(edges)
    while True:
        near = edges.coalesce(1) if before[0] <= ONE_TASK else edges
        edges = shared_table(_star(_star(near, True), False), "links")
        now = _sum(edges)
        if now == before:
            break
        before = now
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return leaves.unionAll(leaves.select(F.col("comp").alias("node"), "comp").distinct())
