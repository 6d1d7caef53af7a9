"""Connected components over a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlight.llm.common import durable, release


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of a link; root is the component's smallest node.

    Large-star and small-star steps in turn, until no link changes; every step hangs nodes under smaller ones, so that
    a chain shortens by half or more each time. Steps are aggregations: a node with very many links is summed up map-side.
    """
    edges = durable(links.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x > y").distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).withColumn("m", F.least("m", "x"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        down = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(down, "x")
        small = small.where("y > m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(down.select("x", F.col("m").alias("y"))).distinct()
        old, edges = edges, durable(small, "links")
        release(old)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    own = edges.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct()
    return edges.select(F.col("x").alias("node"), F.col("y").alias("root")).union(own)
