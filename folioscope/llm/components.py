"""Connected components of a table of links, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scratch import Scratch


def components(links: DataFrame, scratch: Scratch, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (smallest node that links reach) for every node of ``links`` (columns ``a``, ``b``).

    Each round points every node at the smallest node it or its neighbours know. Minima are combined before the
    shuffle, so a node with very many neighbours is no heavy group; the join that follows may be split by Spark. A
    graph of stars needs two rounds, a path about the logarithm of its length. Rounds are written tables.
    """
    pairs = links.filter(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")
    )
    current = scratch.write(pairs.distinct(), "links")
    for _ in range(most_rounds):
        both = current.select(F.col("high").alias("node"), F.col("low").alias("other")).unionAll(
            current.select(F.col("low").alias("node"), F.col("high").alias("other"))
        )
        least = both.groupBy("node").agg(F.min("other").alias("least"))
        least = least.withColumn("least", F.least("node", "least"))
        # Every larger neighbour of a node points to the smallest node around it.
        large = (
            both.filter(F.col("other") > F.col("node"))
            .join(least, "node")
            .select(F.col("other").alias("high"), F.col("least").alias("low"))
            .distinct()
        )
        large = scratch.write(large, "large")
        # Every node and its smaller neighbours point to the smallest of them.
        small = large.groupBy("high").agg(F.min("low").alias("least"))
        joined = large.join(small, "high")
        following = (
            joined.filter(F.col("low") != F.col("least"))
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .unionAll(small.select("high", F.col("least").alias("low")))
            .distinct()
        )
        following = scratch.write(following, "links")
        # Settled once every node has one partner and no partner has one itself.
        open_nodes = following.groupBy("high").count().filter("count > 1").select("high")
        chained = following.select(F.col("low").alias("high")).join(following.select("high"), "high", "left_semi")
        done = open_nodes.unionAll(chained).limit(1).count() == 0
        scratch.drop(current, large)
        current = following
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(
        current.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
