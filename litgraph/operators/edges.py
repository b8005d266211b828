"""Bipartite edges, adjacency, and exports of a graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash_bucket
from ..plans.stage import scratch
from .ordering import dense_ids, first_appearance_ids, global_row_number


def both_directions(pairs: DataFrame) -> DataFrame:
    """Each (src, dst) and its reverse, with the other columns as they are."""
    more = [c for c in pairs.columns if c not in ("src", "dst")]
    return pairs.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e"), *more).select("e.*", *more)


def bipartite_edges(rows: DataFrame, src: Column, neighbours: Column, both_ways: bool = True, disjoint: bool = False) -> DataFrame:
    """Distinct (src, dst); with both_ways, the reverse of each, too. Where no node is on both sides (`disjoint`), pairs are made distinct
    before they are reversed."""
    one = rows.select(src.alias("src"), F.explode(neighbours).alias("dst"))
    if not both_ways:
        return one.distinct()
    return both_directions(one.distinct()) if disjoint else both_directions(one).distinct()


def edge_families(families: dict[str, DataFrame]) -> DataFrame:
    """All families in one table, by edge_type."""
    out = None
    for name, edges in families.items():
        named = edges.select("src", "dst", F.lit(name).alias("edge_type"))
        out = named if out is None else out.unionByName(named)
    return out


def typed_edges(rows: DataFrame, src: Column, families: dict[str, tuple[Column, Callable[[Column], Column], Callable[[Column], Column] | None]]) -> DataFrame:
    """Distinct src, dst, edge_type of all families in one pass over the rows. A family is a column of lists, how one of its values becomes
    a key (different values, different keys), and which values count (all, if None). Values are made distinct within their row; only
    edges of a source that several rows have are compared across rows, so no others are shuffled."""
    rows = rows.withColumn("_src", src)
    several = scratch(rows.groupBy(F.col("_src").alias("_of")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_of"))

    def flat(some: DataFrame) -> DataFrame:
        lists = F.array(*(F.struct(F.lit(name).alias("edge_type"), F.array_distinct(values).alias("values")) for name, (values, _, _) in families.items()))
        one = some.select("_src", F.explode(lists).alias("_f")).select("_src", "_f.edge_type", F.explode("_f.values").alias("_v"))
        kept, key = F.lit(True), F.lit(None).cast("string")
        for name, (_, make, counts) in families.items():
            own = F.col("edge_type") == name
            key = F.when(own, make(F.col("_v"))).otherwise(key)
            kept = kept if counts is None else kept & (~own | counts(F.col("_v")))
        return one.filter(kept).select(F.col("_src").alias("src"), key.alias("dst"), "edge_type")

    if several.isEmpty():
        return flat(rows)
    same = F.col("_src").eqNullSafe(F.col("_of"))
    return flat(rows.join(several, same, "left_anti")).unionByName(flat(rows.join(several, same, "left_semi")).distinct())


#: Values that a row of gathered values holds at most, about.
GATHERED = 100_000


def gathered(rows: DataFrame, key: str, value: str, most: int = GATHERED, distinct: bool = False) -> DataFrame:
    """key, chunk and values: the key's distinct values, sorted. A key with more than about `most` of them has several rows, numbered
    by chunk, among which its values are dealt by hash; all others have chunk 0. `distinct`: the rows are so already."""
    one = rows.select(key, value)
    one = scratch(one if distinct else one.distinct())  # counted, then gathered
    hot = scratch(one.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("_n")).filter("_n > 1"))
    chunk = F.lit(0).cast("long")
    if not hot.isEmpty():
        one = one.join(hot.withColumnRenamed(key, "_hot"), F.col(key).eqNullSafe(F.col("_hot")), "left")
        chunk = F.coalesce(F.pmod(F.xxhash64(value), "_n"), chunk)
    return one.groupBy(key, chunk.alias("chunk")).agg(F.sort_array(F.collect_list(value)).alias("values"))


def adjacency(edges: DataFrame, most: int = GATHERED, distinct: bool = False) -> DataFrame:
    """src, chunk, neighbors: a row for each node, or several for one of very many neighbours (see `gathered`)."""
    return gathered(edges, "src", "dst", most, distinct).withColumnRenamed("values", "neighbors")


def explode_adjacency(adj: DataFrame) -> DataFrame:
    return adj.select("src", F.explode("neighbors").alias("dst"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def cap_degree(edges: DataFrame, most: int, seed: str = "") -> DataFrame:
    """At most `most` neighbours of a node, picked by a hash: the same in every run."""
    from ..functions.hashing import hash64
    from .ordering import top_per_group

    return top_per_group(edges, ["src"], [hash64(F.concat_ws("|", "src", "dst", F.lit(seed))), F.col("dst")], most).drop("rank")


def merge_duplicate_keys(rows: DataFrame, key: str, value: str, most: int = GATHERED) -> DataFrame:
    """key, chunk and its distinct values, sorted; see `gathered`."""
    return gathered(rows, key, value, most)


def entity_partitions(edges: DataFrame, parts: int, kinds: list[str] | None = None) -> DataFrame:
    """Nodes of both ends: name, type, part (by hash), and idx, their place in that part. Nodes are numbered along one order by ranges, so
    there are as many tasks as the nodes need, not one for each type and part."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    nodes = nodes.withColumn("type", F.substring("name", 1, 1)).withColumn("part", hash_bucket(F.col("name"), parts))
    if kinds:
        nodes = nodes.filter(F.col("type").isin(*kinds))
    numbered = global_row_number(nodes, [F.col("type"), F.col("part"), F.col("name")], "_k")
    first = scratch(numbered.groupBy("type", "part").agg(F.min("_k").alias("_first")))
    return numbered.join(F.broadcast(first), ["type", "part"]).select("name", "type", "part", (F.col("_k") - F.col("_first")).alias("idx"))


def relations(buckets: DataFrame) -> DataFrame:
    """The relations that occur, in order, with their numbers from 0; there are no more than pairs of node types."""
    found = buckets.select("rel").distinct()
    return global_row_number(found, [F.col("rel")], "_k").select("rel", (F.col("_k") - 1).alias("rel_id"))


def part_counts(nodes: DataFrame, parts: int) -> DataFrame:
    """Nodes of each type and part; parts without nodes count 0."""
    grid = nodes.select("type").distinct().select("type", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))
    counts = nodes.groupBy("type", "part").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["type", "part"], "left").select("type", "part", F.coalesce("n", F.lit(0)).alias("n"))


def edge_buckets(edges: DataFrame, nodes: DataFrame, relations: list[str] | None = None) -> DataFrame:
    """lhs, rhs (places in their parts), rel (types of both ends) and both parts; edges with an end that isn't listed go."""
    ends = lambda side, name: nodes.select(F.col("name").alias(name), F.col("type").alias(f"{side}_type"), F.col("part").alias(f"{side}_part"), F.col("idx").alias(side))
    joined = edges.join(ends("lhs", "src"), "src").join(ends("rhs", "dst"), "dst").withColumn("rel", F.concat("lhs_type", "rhs_type"))
    if relations:
        joined = joined.filter(F.col("rel").isin(*relations))
    return joined.select("lhs_part", "rhs_part", "lhs", "rel", "rhs")


def edge_list_ids(edges: DataFrame) -> DataFrame:
    """Ends as consecutive ids from 0 in the order of names."""
    ids = dense_ids(edges.select(F.explode(F.array("src", "dst")).alias("name")), "name")
    return edges.join(ids.select(F.col("name").alias("src"), F.col("id").alias("src_id")), "src").join(ids.select(F.col("name").alias("dst"), F.col("id").alias("dst_id")), "dst").select("src_id", "dst_id")


def edge_list_ids_both(pairs: DataFrame) -> DataFrame:
    """`edge_list_ids` of the pairs (src, dst) and their reverses: each pair's ends are looked up once."""
    one = edge_list_ids(scratch(pairs.select("src", "dst")))  # read for the names and for the edges
    return both_directions(one.toDF("src", "dst")).toDF("src_id", "dst_id")


def numbered_edges(edges: DataFrame) -> DataFrame:
    """edge_list_ids from 1, with a running edge number, for exports that need it."""
    return global_row_number(edge_list_ids(edges).select((F.col("src_id") + 1).alias("src_id"), (F.col("dst_id") + 1).alias("dst_id")), [F.col("src_id"), F.col("dst_id")], "edge_id")


def edge2vec_rows(edges: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of edges (src, dst, relation, and the columns of `order`, which number them): rows src_id, dst_id, rel_id, edge_id, and the ids of nodes
    and of relations, all from 1 in the order of their first appearance. An edge's source appears before its target."""
    edges = scratch(edges.select(*dict.fromkeys(["src", "dst", "relation", *order])))  # read for the nodes, the relations and the edges
    place = F.struct(*order)
    ends = edges.select(F.posexplode(F.array("src", "dst")).alias("_end", "name"), *order)
    nodes = first_appearance_ids(ends, "name", [*order, "_end"], 1)
    rels = first_appearance_ids(edges, "relation", order, 1)
    numbered = global_row_number(edges.select("src", "dst", "relation", place.alias("_at")), [F.col("_at")], "edge_id")
    end = lambda side: nodes.select(F.col("name").alias(side), F.col("id").alias(f"{side}_id"))
    out = numbered.join(end("src"), "src").join(end("dst"), "dst").join(rels.withColumnRenamed("id", "rel_id"), "relation")
    return out.select("src_id", "dst_id", "rel_id", "edge_id"), nodes, rels


def predicate_nodes(edges: DataFrame) -> DataFrame:
    """The set of predicate keys among both ends."""
    from ..functions.keys import is_predicate

    return edges.select(F.explode(F.array("src", "dst")).alias("name")).filter(is_predicate(F.col("name"))).distinct()
