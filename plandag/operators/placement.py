"""Which replica of a file to read, as a ranking query over replicas and node metrics. Spark places its own tasks; this is for reports and planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def best_replicas(replicas: DataFrame, metrics: DataFrame, shared: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """replicas: (file, node); metrics: (node, score), the higher the better. (file, node, score) of the best replica of each file.

    Files with one replica leave no choice; a node that k of them are read from has its score divided by k + 1 for all other files. Nodes
    without metrics have the score 0. Ties go to the smallest node.
    shared: (file, group) and (group, node), for more replicas: those of a file are all nodes of its groups. A group is ranked once, whatever
    the number of its files, so no pairs of files and nodes are made.
    """
    own = replicas.select("file", "node")
    files, groups = (df.select(*names) for df, names in zip(shared, (("file", "group"), ("group", "node")), strict=True)) if shared else (None, None)

    def together(own: DataFrame, of_groups: DataFrame | None) -> DataFrame:
        """What is known of replicas and of groups, by file."""
        return own if of_groups is None else own.unionByName(files.join(of_groups, "group").drop("group"))

    spans = together(own.select("file", *_ends(F.col("node"))), groups and groups.groupBy("group").agg(*_span(*_ends(F.col("node")))))
    forced = spans.groupBy("file").agg(*_span("low", "high", "unknown")).where(~_choice() & F.col("low").isNotNull())
    forced = forced.groupBy(F.col("low").alias("node")).agg((F.count(F.lit(1)) + 1).alias("penalty"))
    scores = metrics.groupBy("node").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))

    def ranked(df: DataFrame) -> DataFrame:
        """With a struct that is the smaller the better the replica is, if there is a choice."""
        score = F.coalesce("score", F.lit(0.0))
        less = score / F.coalesce("penalty", F.lit(1))
        rank = F.struct((~F.isnan(less)).alias("number"), (-less).alias("less"), F.col("node").isNull().alias("unknown"), "node", (score / 1).alias("score"))
        return df.join(scores, "node", "left").join(forced, "node", "left").withColumn("rank", rank)

    of_groups = groups and ranked(groups).groupBy("group").agg(*_span(*_ends(F.col("node"))), F.min("rank").alias("rank"))
    best = together(ranked(own).select("file", *_ends(F.col("node")), "rank"), of_groups).groupBy("file").agg(*_span("low", "high", "unknown"), F.min("rank").alias("rank"))
    return best.select("file", F.col("rank.node").alias("node"), F.when(_choice(), -F.col("rank.less")).otherwise(F.col("rank.score")).alias("score"))


def _ends(node: Column) -> list[Column]:
    return [node.alias("low"), node.alias("high"), node.isNull().alias("unknown")]


def _span(low: object, high: object, unknown: object) -> list[Column]:
    """The smallest and the largest node, and whether one is NULL: enough to tell one node from several."""
    return [F.min(low).alias("low"), F.max(high).alias("high"), F.bool_or(unknown).alias("unknown")]


def _choice() -> Column:
    return F.col("low").isNotNull() & ((F.col("low") != F.col("high")) | F.col("unknown"))
