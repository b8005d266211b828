"""Connected components by alternating stars, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def connected(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (a, b: long).

    Each round points every node's larger neighbours, then its smaller ones, to its smallest neighbour. Minima are partial aggregates,
    written down before they meet the edges again, so that the join can split a node with a third of all edges. Ends when a round changes
    nothing.
    """
    current = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "cc")
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "cc")
        large = written(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct(), "cc")
        drop(least)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc")
        small = large.join(least, "u")
        new = written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "cc")
        drop(large)
        drop(least)
        same = new.count() == current.count() and new.join(current, ["u", "v"], "left_anti").isEmpty()
        drop(current)
        current = new
        if same:
            break
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
