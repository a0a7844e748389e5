"""Connected components of links, by alternating large-star and small-star steps. Nothing is gathered on the driver but two sums a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plandag.llm.shared import drop_table, materialize


def components(links: DataFrame) -> DataFrame:
    """links: (a, b), any direction, repeats and loops allowed. (a, b) for each node a but the smallest of its component, b."""
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges")
    seen = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if now == seen or not now.n:
            return edges
        seen = now
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written first, so that the join is one of two plain exchanges, whose skewed partitions (hubs) Spark splits.
        least = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Each node's smaller neighbours, and the node, go to the smallest of them.
        large = materialize(large, "large-star")
        drop_table(least)
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, materialize(small, "edges")
        for done in (before, large, least):
            drop_table(done)
