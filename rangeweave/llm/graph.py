"""Connected components of an edge table, by alternating stars.

Each round every node hands its larger neighbours to its smallest one (large star), then its smaller ones (small star); edges
shrink to one star for each component in a number of rounds that grows with the logarithm of the longest path.  All steps are
partial aggregations and equi-joins, so a node with very many edges is aggregated before the exchange and split by the join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialize, release, settings


def is_stars(edges: DataFrame) -> bool:
    """Whether no node is both a leaf and a centre."""
    with settings(edges.sparkSession):
        return edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): for every node of a pair the smallest node it is connected with.  Pairs of a node with itself or with null are ignored."""
    edges = materialize(pairs.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while not is_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        last, large = edges, materialize(large, "edges")
        release(last)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(large)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
