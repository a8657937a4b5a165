"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.storage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of an edge (a, b); component is the smallest node that it can reach.

    Each step replaces a node's edges by edges to the smallest of its neighbours; the graph becomes a set of stars
    in a number of steps that grows with the logarithm of the longest path. The smallest neighbour of a hub is
    found by partial aggregation and joined back as a table of its own, so a hub's edges may be split over tasks.
    """
    pairs = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = written(large.distinct(), "large")
        least = written(pairs.groupBy("a").agg(F.min("b").alias("m")), "least")
        linked = pairs.join(least, "a")
        small = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        pairs = written(small.distinct(), "small")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before = now
