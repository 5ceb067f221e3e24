"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): label is the least node of its component.

    Each round joins every node to the least neighbour it knows; edges never get more. Rounds end
    when the edge set stands still. Only one count and one checksum per round reach the driver.
    """
    state = None
    edges = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "edges")
    while True:
        # large star: all greater neighbours of a node go to its least neighbour
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low"))
        least = least.select(F.col("a").alias("node"), F.least("a", "low").alias("low"))
        large = both.join(least, both.a == least.node).filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.filter("a != b").distinct()
        # small star: the lesser neighbours of a node, and itself, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
        moved = large.join(low, large.a == low.node)
        small = moved.select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(
            low.select(F.col("node").alias("a"), F.col("low").alias("b"))
        )
        edges = settled(small.filter("a != b").distinct(), "stars")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if tuple(now) == state:
            break
        state = tuple(now)
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
