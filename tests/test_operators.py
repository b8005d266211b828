import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.operators import concepts, edges, kv, knn, ngrams, ordering, paths, predicates, ranking, sentences
from litgraph.plans.stage import StageStore
from litgraph.sources.schemas import DOCUMENT


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_sentences_number_only_kept_ones(spark):
    parts = [{"text": "Hi. A longer sentence. No.", "type": "title"}, {"text": "Another long sentence.", "type": "body"}]
    docs = spark.createDataFrame([("Ab1", None, None, None, None, parts, [], [], [], [])], DOCUMENT)
    assert rows(sentences.parts_to_sentences(docs).select("id", "sent_idx", "sent_total", "sent_type")) == [("s:ab1:1:0", 0, 2, "title"), ("s:ab1:1:1", 1, 2, "body")]


def test_edges(spark):
    one = spark.createDataFrame([("s:1", ["a", "b", "a"]), ("s:2", ["b"])], "id string, near array<string>")
    graph = edges.bipartite_edges(one, F.col("id"), F.col("near"))
    assert graph.count() == 6 and graph.join(graph.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"]).count() == 6
    assert rows(edges.explode_adjacency(edges.adjacency(graph))) == rows(graph)
    assert rows(edges.degrees(graph)) == [("a", 1), ("b", 2), ("s:1", 2), ("s:2", 1)]
    assert edges.cap_degree(graph, 1).groupBy("src").count().agg(F.max("count")).first()[0] == 1
    assert rows(edges.edge_list_ids(graph).filter("src_id < 2")) == [(0, 2), (1, 2), (1, 3)]


def test_global_order(spark):
    df = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "k long, v long")
    assert rows(ordering.global_row_number(df, [F.col("k")]).select("row_number", "k")) == [(i + 1, i) for i in range(101)]
    assert rows(ordering.batches(df, [F.col("k")], 10).groupBy("batch").count())[-1] == (10, 1)


def test_kv(spark):
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert rows(kv.get(one, "b")) == [("b", "2")]
    assert rows(kv.contains(one, spark.createDataFrame([("a",), ("z",)], "key string"))) == [("a", True), ("z", False)]


def test_ngrams(spark):
    token = "array<struct<lemma: string, pos: string, stop: boolean>>"
    t = lambda w, stop=False: (w, "NOUN", stop)
    df = spark.createDataFrame([([t("lung"), t("of", True), t("cell")],), ([],), (None,)], f"tokens {token}")
    assert [r[0] for r in df.select(ngrams.candidate_ngrams(F.col("tokens"), 3)).collect()][:2] == [["lung_of_cell"], []]


def test_all_frequent_phrases_annotate(spark, tmp_path, monkeypatch):
    from litgraph.plans import text_queries

    monkeypatch.setattr(text_queries, "LATE", 1)
    docs = [(k, f"alpha{k} beta{k}", "en", "s") for k in range(600)] + [(600, None, "en", "s")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in text_queries.phrase_annotate(spark, f"file://{tmp_path}").collect()}
    assert len(got) == 601 and all(got[k].phrases == f"alpha{k}_beta{k}" and got[k].n_phrases == 1 for k in range(600))


def test_paths(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")]
    graph = spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "src string, dst string")
    assert dict(rows(paths.hop_distances(graph, "a", 5))) == {"a": 0, "b": 1, "x": 1, "c": 2, "d": 2}
    assert paths.shortest_path(graph, "a", "d") == ["a", "x", "d"]
    assert paths.shortest_path(graph, "a", "q") is None
    given = [("a", "b", 1.0), ("a", "x", 5.0), ("b", "c", 1.0), ("c", "d", 1.0), ("x", "d", 1.0)]
    weighted = spark.createDataFrame(given, "src string, dst string, weight double")
    assert paths.weighted_path(weighted, "a", "d") == (3.0, ["a", "b", "c", "d"]) and paths.weighted_path(weighted, "d", "a") is None
    assert {r[2] for r in rows(paths.edge_weights(graph))} == {math.log2(3)}


def test_predicates(spark):
    given = spark.createDataFrame([("C1|C2", "one|two", "N1", "n")], "subj_ids string, subj_names string, obj_ids string, obj_names string")
    assert rows(predicates.split_terms(given)) == [("C1", "one", "N1", "n"), ("C2", "two", "N1", "n")]
    dated = spark.createDataFrame([("k", "2015-00-00"), ("k", "2014-01-01"), ("q", None)], "key string, date string")
    assert rows(predicates.earliest(dated)) == [("k", "2014-01-01"), ("q", "9999-99-99")]


def test_closest_text_keeps_ties(spark):
    atoms = spark.createDataFrame([("lung",), ("lungs",), ("long",)], "str string")
    assert rows(concepts.closest_texts(atoms, ["lang"])) == [("lang", 1, "long"), ("lang", 1, "lung")]


def test_knn_matches_brute_force(spark):
    x = np.random.default_rng(0).normal(size=(60, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.src, r.rank): r.dst for r in knn.exact_knn(df.filter("vec_id % 10 = 0"), df, "vec_id", "embedding", 3).collect()}
    for q in range(0, 60, 10):
        d = ((x.astype(np.float64) - x[q]) ** 2).sum(1)
        assert [got[q, k] for k in (1, 2, 3)] == np.argsort(d)[1:4].tolist()
    with pytest.raises(ValueError):
        knn.IvfPq.train(x.astype(np.float64), 4, 3, 16)


def test_registered_index_search_recall(spark, tmp_path):
    from litgraph.plans import graph_queries

    x = np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 5) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    exact, found = ({(r.src, r.dst) for r in q(spark, f"file://{tmp_path}").collect()} for q in (graph_queries.knn_exact, graph_queries.ivf_search))
    assert len(exact) == 300 and len(exact & found) >= 270


def test_ranking(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.1, 0)], "id long, score double, label int")
    assert rows(ranking.ranked(df, "score", "label", "id").select("rank", "id")) == [(1, 1), (2, 3), (3, 2), (4, 4)]
    assert ranking.roc_auc(df, "score", "label").first()[0] == 3.5 / 4
    assert ranking.average_precision(df, "score", "label").first()[0] == pytest.approx(0.5 + 0.5 * 2 / 3)
    assert ranking.balanced(df, "label", [F.col("id")]).count() == 4


def test_stage_store(spark, tmp_path):
    store = StageStore(spark, f"file://{tmp_path}")
    calls = []

    def compute():
        calls.append(1)
        return spark.range(3)

    assert store.stage("one_edges", compute).count() == 3 and store.stage("one_edges", compute).count() == 3 and len(calls) == 1
    store.stage("two_edges", spark.range(2))
    assert store.names("_edges") == ["one_edges", "two_edges"] and store.union("_edges").count() == 5
    store.clear("one_edges")
    assert not store.done("one_edges")
    with pytest.raises(StopIteration):
        StageStore(spark, f"file://{tmp_path}", halt_after="two_edges").stage("two_edges", compute)
