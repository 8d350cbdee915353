"""Connected components of a graph of links, as a table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.tables import written


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """Written, so that a join with it can be split where a node has very many neighbours."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node in ``links`` (a, b).

    Large stars tie every larger neighbour of a node to the node's least neighbour, small
    stars every smaller one; after some rounds each component is one star around its smallest
    node. Each round is written, so lineage stays short and no node, link or label passes
    through the driver: it sees two sums that tell when nothing changes any more.
    """
    edges = written(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least_neighbour(both), "u")
            .filter("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        # Of a node's smaller neighbours all but the least are tied to the least, and so is the node.
        large = written(large, "large")
        small = (
            large.join(_least_neighbour(large), "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v")
            .distinct()
        )
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
