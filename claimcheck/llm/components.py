"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimcheck.llm.common import tidy, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's neighbours linked to the least of them: all larger ones, or all smaller ones and itself."""
    if large:
        near = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    both = near.join(least, "u")
    if large:
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return both.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


@tidy
def components(edges: DataFrame) -> DataFrame:
    """node and label (the least node of its component) of every node with a link; edges are pairs (u, v) of longs."""
    edges = written(edges.where("u != v").select("u", "v").distinct())
    state = None
    while True:
        edges = written(_star(_star(edges, True), False))
        sums = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == tuple(sums):
            break
        state = tuple(sums)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).union(edges.select("v", "v").distinct())
