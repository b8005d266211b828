"""The network between topics (`topic_model` fits them), and what a graph key is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .paths import nearby_nodes


def topic_network(terms: DataFrame, source: str, target: str) -> DataFrame:
    """a, b, similarity (sum of lesser over sum of greater weights) in both directions where it is above 0. Topics are 0, 1, ...; the
    source is -1 and the target -2, each a single word of weight 1. Topics that share no word have nothing in common, so only those that
    do meet, by their words."""
    ends = terms.sparkSession.createDataFrame([(-1, source, 1.0), (-2, target, 1.0)], "topic int, word string, weight double")
    every = terms.select(F.col("topic").cast("int").alias("topic"), "word", F.col("weight").cast("double").alias("weight")).unionByName(ends)
    total = every.groupBy("topic").agg(F.sum("weight").alias("total"))
    x, y = (every.select(F.col("topic").alias(t), "word", F.col("weight").alias(w)) for t, w in (("a", "u"), ("b", "v")))
    common = x.join(y, "word").filter("a <> b").groupBy("a", "b").agg(F.sum(F.least("u", "v")).alias("low"))
    both = common.join(total.select(F.col("topic").alias("a"), F.col("total").alias("p")), "a").join(total.select(F.col("topic").alias("b"), F.col("total").alias("q")), "b")
    return both.select("a", "b", (F.col("low") / (F.col("p") + F.col("q") - F.col("low"))).alias("similarity")).filter("similarity > 0")


def node_name(topic, source: str, target: str):
    return F.when(topic == -1, F.lit(f"Source: {source}")).when(topic == -2, F.lit(f"Target: {target}")).otherwise(F.concat(F.lit("Topic "), topic.cast("string")))


def plaintext(bags: DataFrame, key: str, bow: str | Column, edges: DataFrame, node: str, most: int = 100, kind: str = "s") -> DataFrame:
    """The most frequent word of the `most` sentences nearest to a graph key (word, n), the first seen among equals. `bags` have a sentence
    key and its words (or what `bow` makes words of, once the sentences are found); the walk over the edges widens until it has the sentences."""
    near = nearby_nodes(edges, node, kind, most).withColumn("_place", F.row_number().over(Window.orderBy("d", "node")))  # `most` rows
    words = bags.join(F.broadcast(near.select(F.col("node").alias(key), "_place")), key).select(F.posexplode(bow).alias("_i", "word"), "_place")
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_place", "_i")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").limit(1).select("word", "n")
