"""What grows with the input, and the step that keeps it small."""

from pyspark.sql import functions as F

from litgraph.functions.text import is_interesting
from litgraph.operators import edges, generator, paths
from litgraph.plans import graph_queries


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_recall_moves_ngrams_without_their_row(spark):
    data = [(1, ["a", "b", "c", "d"], ["a", "b"], ["a"]), (2, ["a", "x"], None, ["a"]), (3, None, ["a"], []), (4, ["a", "a"], ["a"], ["a"])]
    df = spark.createDataFrame(data, "k int, target array<string>, generated array<string>, title array<string>")
    found = generator.recall_minus_title(df, "k", F.col("generated"), F.col("target"), F.col("title"), spark.createDataFrame([("b", 3), ("c", 1), ("d", 1)], "ngram string, n long"))
    assert [(k, round(r, 6)) for k, r in rows(found)] == [(1, 0.2), (2, 0.0), (3, 1.0), (4, 1.0)]
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_contains" not in joined  # the list would have to travel with each of its n-grams


def test_families_in_one_pass_shuffle_only_edges_of_shared_sources(spark):
    once = [("a", ["x", "the", "x", None], ["p"]), ("b", ["x"], None), (None, [], ["p"])]
    twice = once + [("a", ["x", "zz"], ["p", "q"]), (None, ["z"], ["p"])]
    for data, shuffled in ((once, False), (twice, True)):
        df = spark.createDataFrame(data, "id string, w array<string>, e array<string>")
        found = edges.typed_edges(df, F.col("id"), {"word": (F.col("w"), lambda w: F.concat(F.lit("l:"), w), is_interesting), "entity": (F.col("e"), lambda e: e, None)})
        want = {(i, f"l:{w}", "word") for i, ws, _ in data for w in ws or [] if w not in (None, "the")} | {(i, e, "entity") for i, _, es in data for e in es or []}
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want
        assert ("Aggregate" in found._jdf.queryExecution().optimizedPlan().toString()) == shuffled


def test_pairs_weigh_as_the_edges_between_them(spark):
    pairs = spark.createDataFrame([(1, 7), (1, 8), (1, 9), (2, 7), (3, 9), (None, 9)], "c long, p long")
    named = pairs.select(F.concat(F.lit("c"), "c").alias("src"), F.concat(F.lit("p"), "p").alias("dst"))
    one = paths.pair_weights(pairs, "c", "p")
    assert "concat" not in one._jdf.queryExecution().optimizedPlan().toString() and one.schema["c"].dataType.simpleString() == "bigint"
    got = edges.both_directions(one.select(F.concat(F.lit("c"), "c").alias("src"), F.concat(F.lit("p"), "p").alias("dst"), "weight"))
    want = paths.edge_weights(edges.both_directions(named))
    assert rows(got) == rows(want) and got.count() == 10


def test_ids_of_both_directions(spark):
    pairs = spark.createDataFrame([("a", "p"), ("b", "p"), ("a", "q"), ("c", None)], "src string, dst string")
    assert rows(edges.edge_list_ids_both(pairs)) == rows(edges.edge_list_ids(edges.both_directions(pairs)))
    assert edges.edge_list_ids_both(pairs).count() == 6


def test_shared_pairs_are_joined_once(spark, tmp_path):
    spark.createDataFrame([(i, i % 5) for i in range(30)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 30, i % 7) for i in range(90)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    for query in (graph_queries.edge_list_ids, graph_queries.relation_list, graph_queries.negative_pairs):
        assert "lineitem" not in query(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def test_parts_of_the_graph_grow_with_its_lines(spark, monkeypatch):
    """a task of the customer-part graph holds a bounded number of lines, and distinct edges aren't made distinct again."""
    from litgraph.operators import edges as E
    from litgraph.plans import graph_queries as G

    where, lines = "/root/testdata/sf0.001", spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    before = sorted(G._bought(spark, where).collect())
    monkeypatch.setattr(G, "TASK_ROWS", lines // 40)
    dealt = G._bought(spark, where)
    assert sorted(dealt.collect()) == before and dealt.rdd.getNumPartitions() >= 40
    graph = G._graph(spark, where)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(E.adjacency(graph, distinct=True)) == rows(E.adjacency(graph))


def test_swaps_exchange_numbers_alone(spark, tmp_path):
    """draws meet terms and known pairs as numbers, and what isn't drawn as a subject and an object doesn't meet the known pairs."""
    from litgraph.operators import ranking

    spark.createDataFrame([(i, i * 7 % 23) for i in range(60)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 60, i * 5 % 17) for i in range(240)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    positives = graph_queries._customer_parts(spark, str(tmp_path)).toDF("subj", "obj")
    want = ranking.negative_pairs(positives, positives.select(F.explode(F.array("subj", "obj")).alias("term")).distinct(), 2)
    assert positives.count() < want.count() < 2 * positives.count()  # some draws are known pairs

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = graph_queries.negative_pairs(spark, str(tmp_path))
        assert got.dtypes == want.dtypes and rows(got) == rows(want.select(got.columns))
        plan, joined = [got._jdf.queryExecution().optimizedPlan()], set()
        while plan:
            node = plan.pop()
            below = [node.children().apply(i) for i in range(node.children().size())]
            if node.nodeName() == "Join":
                joined |= {c.output().apply(i).dataType().simpleString() for c in below for i in range(c.output().size())}
            plan += below
        assert joined == {"bigint", "int"} or joined == {"bigint"}
        again = got.select("*")
        again.collect()
        assert "ReusedExchange" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_swaps_of_pairs_with_nulls(spark, tmp_path):
    """as in SQL, null is the last term and a pair with a null has no draws."""
    import duckdb

    spark.createDataFrame([(i, None if i % 9 == 0 else i % 5) for i in range(30)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 30, None if i % 11 == 0 else i % 7) for i in range(90)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(graph_queries.ORACLES["negative_pairs"]).fetchall()
    got = graph_queries.negative_pairs(spark, str(tmp_path)).select("subj", "obj", "draw", "neg_subj", "neg_obj").collect()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
