"""A query on a built graph: the path between two keys, the sentences near it, and the topics of these."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ngrams, paths
from ..operators.edges import cap_degree
from ..operators.topic_model import fit_topics
from ..operators.topics import node_name, plaintext, topic_network
from .config import TopicConfig
from .stage import scope, scratch


def topic_query(graph: DataFrame, bags: DataFrame, source: str, target: str, config: TopicConfig, by_weight: bool = True) -> DataFrame:
    """One row: source, target, path, documents (id, topics), topics (topic, word, weight) and network (a, b, similarity, by names). All of
    them are bounded by the settings: nodes of the path, `nearby` sentences for each, ten words for each topic.

    `graph` has src and dst, `bags` id and bow. Keys that the graph lacks, and keys that no path connects, are errors. The row is a table; all
    others that the query makes are gone when it returns."""
    with scope() as made:
        out = scratch(_topic_query(graph, bags, source, target, config, by_weight))
        made.remove(out)
    return out


def _topic_query(graph: DataFrame, bags: DataFrame, source: str, target: str, config: TopicConfig, by_weight: bool) -> DataFrame:
    nodes = graph.select(F.col("src").alias("node")).distinct()
    for key in (source, target):
        if nodes.filter(F.col("node") == key).isEmpty():
            raise KeyError(f"the graph has no key {key}")
    edges = scratch(cap_degree(graph, config.max_degree))
    if by_weight:
        found = paths.weighted_path(paths.edge_weights(edges), source, target)
        path = found and found[1]
    else:
        path = paths.shortest_path(edges, source, target)
    if not path:
        raise ValueError(f"no path connects {source} and {target}")
    near = scratch(paths.near_path(edges, path, "s", config.nearby))
    own = scratch(bags.join(F.broadcast(near.withColumnRenamed("node", "id")), "id").select("id", "bow"))
    kept = ngrams.prune_low_support(own, "id", "bow", config.least_df)
    words = F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"])  # of one sentence
    pruned = scratch(kept.groupBy("id").agg(words.alias("bow")))
    mixes, terms = fit_topics(pruned, "bow", config.topics, config.rounds, config.seed, least_df=1)
    names = [r.word if (r := plaintext(bags, "id", "bow", edges, key).first()) else key for key in (source, target)]
    network = topic_network(terms, *names)
    network = network.select(*(node_name(F.col(c), source, target).alias(c) for c in ("a", "b")), "similarity")
    gathered = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    spark = graph.sparkSession
    out = spark.createDataFrame([(source, target, path)], "source string, target string, path array<string>")
    for df, name in ((mixes.select("id", "topics"), "documents"), (terms, "topics"), (network, "network")):
        out = out.join(F.broadcast(gathered(df, name)))  # one row to one row
    return out
