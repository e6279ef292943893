"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import kept


def _large_stars(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are tied to the smallest of itself and its neighbours."""
    up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
    least = edges.unionByName(up).groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return up.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_stars(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    joined = edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")
    ties = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return joined.select(ties.alias("e")).select("e.u", "e.v").filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of edges(u, v); nodes are longs.

    Alternating large-star and small-star rounds, each written to the shared
    folder, until every edge joins a node to its component's smallest: until no
    node has two edges upwards, or edges in both directions.
    """
    edges = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        edges = kept(_small_stars(_large_stars(edges)), "stars")  # all of them have u > v
        ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
        if not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or (up = 1 and down = 1)").take(1):
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
