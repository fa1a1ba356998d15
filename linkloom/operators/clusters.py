"""Groups of linked records: connected components by alternating stars (Kiveris and others, 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import drop, new_folder, stored
from .skew import spread_join


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node but a component's least: label is the least node connected with it.

    edges: (a, b) with a < b, of any type that has an order. In a round every node's greater
    neighbours are tied to its least one, then its smaller ones, so a large component's node has
    few edges left after few rounds. The star of a large component's least node is one key: its edges
    are dealt to several tasks. Every round is written to the shared folder, which cuts the lineage,
    and the round before is deleted; nothing goes to the driver but counts and a hash sum.
    """
    spark = edges.sparkSession
    folder, i = new_folder(spark, "components"), 0
    now, seen = stored(edges.select("a", "b").distinct(), f"{folder}/0"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = spread_join(now, least, "a", "b").select(F.col("m").alias("a"), "b").distinct()  # b's star goes to m
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = spread_join(large, least, "b", "a", now).select(F.col("m").alias("x"), F.col("a").alias("y")).where("x <> y")
        joined = small.union(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
        i += 1
        now = stored(joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), f"{folder}/{i}")
        drop(spark, f"{folder}/{i - 1}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).collect()[0]
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("label"))
        seen = state


def clusters(links: DataFrame) -> DataFrame:
    """(node, cluster): the least node reachable over links (a, b), for every node of a link."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b")
    found = components(edges).select("node", F.col("label").alias("cluster"))
    # A least node has no row of its own; one that is linked with itself alone isn't in an edge.
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(found.select("node"), "node", "left_anti")
    return found.unionByName(alone.withColumn("cluster", F.col("node")))
