"""Connected components as an iterated DataFrame plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected_components(edges: DataFrame, save: Callable[[DataFrame, str], DataFrame], rounds: int = 60) -> DataFrame:
    """(node, component) of every node of an edge list (src, dst); the component is its smallest node.

    Large-star and small-star rounds in turn: links are moved to smaller
    neighbours until every component is a star.  The number of links never
    grows, a node's neighbours are only ever reduced to their minimum, and
    ``save`` writes each round, which cuts lineage.
    """

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("a").agg(F.min("b").alias("m"))

    links = save(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct(), "cc0")
    last = None
    for i in range(1, rounds + 1):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = least(both).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = least(large)
        small = large.join(low, "a")
        moved = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = save(moved.unionByName(low.withColumnRenamed("m", "b")).distinct(), f"cc{i}")
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = links.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
