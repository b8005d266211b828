"""Operators, sources and sinks beside the catalogue's queries, and whole runs of the engine."""

import heapq
import json
import random
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.functions.arrays import close, positional_encoding
from litgraph.functions.text import all_text, ascii_fold, cased_tokens, entity_spans, entity_text, normal_space, without_stop_entities
from litgraph.operators import edges as E
from litgraph.operators import generator, hooks, knn, kv, ngrams, ordering, paths, predicates, ranking, topics
from litgraph.plans.build import build
from litgraph.plans.config import BuildConfig, PhraseConfig, TopicConfig, VectorConfig
from litgraph.plans.stage import scratch, shared_dir
from litgraph.plans.topic_query import topic_query
from litgraph.sources import datasets, readers, sinks
from litgraph.sources.schemas import DOCUMENT
from litgraph.streaming.arrivals import windowed_counts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def graph_of(pairs):
    return [(a, b) for a, b in pairs] + [(b, a) for a, b in pairs]


def test_entities_by_rule(spark):
    text = "The Acme Lung Institute met Anna. Of The And then Bob Ross"
    tokens = cased_tokens(F.lit(text))
    spans = entity_spans(F.col("t"))
    one = spark.range(1).select(tokens.alias("t")).select("t", spans.alias("e"))
    assert [tuple(e)[:2] for e in one.first().e] == [(0, 4), (5, 9), (10, 12)]
    kept = one.select(F.transform(without_stop_entities(F.col("e"), F.col("t")), lambda e: entity_text(e, F.col("t"))).alias("x")).first().x
    assert kept == ["the_acme_lung_institute", "anna_of_the_and", "bob_ross"]
    stops = spark.range(1).select(cased_tokens(F.lit("say Of The")).alias("t")).select("t", entity_spans(F.col("t")).alias("e"))
    assert stops.select(F.size("e"), F.size(without_stop_entities(F.col("e"), F.col("t")))).first() == (1, 0)
    assert spark.createDataFrame([(None,)], "x string").select(cased_tokens(F.col("x")).alias("t")).select(entity_spans(F.col("t"))).first()[0] == []


def test_ngram_rows_equal_candidates(spark):
    from litgraph.functions.text import tokens, words

    texts = [("lung of cell quickly grown cells",), ("of of",), ("",), (None,), ("one",)]
    df = spark.createDataFrame(texts, "text string")
    want = sorted(g for r in df.select(ngrams.candidate_ngrams(tokens(F.col("text")), 3)).collect() for g in r[0] or [])
    assert sorted(r.ngram for r in ngrams.ngram_rows(df.select(words(F.col("text")).alias("w")), F.col("w"), 3).collect()) == want


def test_annotation_equals_brute_force(spark):
    rng = random.Random(1)
    texts = [(i, [rng.choice("bcfgh") for _ in range(rng.randrange(0, 30))]) for i in range(60)]
    model = {"_".join(p) for p in (("b", "c"), ("c", "f", "b"), ("g", "h"), ("h", "g", "b"), ("f", "f"))}
    want = {}
    for i, w in texts:
        at, found = 0, []
        while at < len(w):
            n = next((n for n in (3, 2) if at + n <= len(w) and "_".join(w[at : at + n]) in model), 1)
            found += ["_".join(w[at : at + n])] if n > 1 else []
            at += n
        want[i] = found
    df = spark.createDataFrame(texts, "id long, lemmas array<string>")
    got = ngrams.annotate(df, "id", "lemmas", spark.createDataFrame([(m,) for m in model], "ngram string"), 3)
    assert {r.id: r.ngrams for r in got.collect()} == want


def test_gathered_splits_hot_keys(spark):
    df = spark.createDataFrame([("hot", str(i % 50)) for i in range(200)] + [("cold", "x"), (None, "y")], "k string, v string")
    got = E.gathered(df, "k", "v", most=10).collect()
    assert len([r for r in got if r.k == "hot"]) > 1 and sorted(v for r in got if r.k == "hot" for v in r["values"]) == sorted(map(str, range(50)))
    assert [(r.chunk, r["values"]) for r in got if r.k != "hot"] == [(0, ["x"]), (0, ["y"])] or {(r.k, r.chunk) for r in got if r.k != "hot"} == {("cold", 0), (None, 0)}


def test_join_with_a_written_aggregate_splits_a_hot_key(spark):
    for k, v in {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}.items():
        spark.conf.set(k, v)
    try:
        df = scratch(spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("long").alias("src"), F.col("id").alias("dst")))
        joined = paths.edge_weights(E.both_directions(df))
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_weighted_search_equals_dijkstra(spark):
    rng = random.Random(3)
    pairs = {(f"{rng.choice('es')}:{rng.randrange(40)}", f"{rng.choice('es')}:{rng.randrange(40)}") for _ in range(140)}
    links = {}
    for a, b in pairs:
        if a != b:
            w = round(rng.random() + 0.1, 3)
            links.setdefault(a, []).append((b, w))
            links.setdefault(b, []).append((a, w))
    source = min(links)
    best, heap = {source: 0.0}, [(0.0, source)]
    while heap:
        d, n = heapq.heappop(heap)
        for m, w in links[n] if d == best[n] else ():
            if d + w < best.get(m, 1e9):
                best[m] = d + w
                heapq.heappush(heap, (d + w, m))
    df = spark.createDataFrame([(a, b, w) for a, l in links.items() for b, w in l], "src string, dst string, weight double")
    assert {r.node: r.d for r in paths.weighted_distances(df, source).collect()} == pytest.approx(best)
    far = max(best, key=best.get)
    d, path = paths.weighted_path(df, source, far)
    weight = {(a, b): w for a, l in links.items() for b, w in l}
    assert d == pytest.approx(best[far]) and path[0] == source and path[-1] == far and sum(min(w for m, w in links[a] if m == b) for a, b in zip(path, path[1:])) == pytest.approx(d) and weight
    want = sorted((best[n], n) for n in best if n[0] == "s" and n != source)[:5]
    assert [(pytest.approx(r.d), r.node) for r in paths.nearby_by_weight(df, source, "s", 5).collect()] == want
    assert paths.nearby_by_weight(df, source, "s", 5, max_degree=1).count() <= 5


def test_hop_search_tells_apart_what_it_knows(spark):
    df = spark.createDataFrame(graph_of([("s:a", "e:b"), ("e:b", "s:c"), ("s:c", "e:d"), ("e:d", "s:e"), ("s:x", "s:y")]), "src string, dst string")
    assert rows(paths.nearby_nodes(df, "s:a", "s", 1)) == [("s:c", 2)] and paths.nearby_nodes(df, "s:a", None, 10).count() == 4
    assert paths.shortest_path(df, "s:a", "s:e") == ["s:a", "e:b", "s:c", "e:d", "s:e"] and paths.shortest_path(df, "s:a", "s:x") is None
    with pytest.raises(LookupError):
        paths.shortest_path(df, "s:a", "s:e", most=2)
    assert rows(paths.near_path(df, ["e:b", "e:d"], "s", 2, hops=1)) == [("s:a",), ("s:c",), ("s:e",)]
    found = paths.hop_distances(df, "s:a", 1)
    assert paths.reset(found, "d").columns == ["node"] and rows(paths.reset(found, "d", 9)) == [("e:b", 9), ("s:a", 9)]


def test_pair_scorer_learns(spark):
    rng = random.Random(5)
    pairs, edges = [], []
    for i in range(60):
        a, b, label = f"m:a{i}", f"m:b{i}", i % 2
        near = [f"p:x{rng.randrange(50)}:v:y{j}" for j in range(8)]
        edges += [(a, n) for n in near] + [(b, n) for n in (near if label else [f"p:z{i}:v:y{j}" for j in range(8)])]
        pairs.append((a, b, label))
    df, graph = spark.createDataFrame(pairs, "subj string, obj string, label int"), spark.createDataFrame(edges + [(p[0], "l:noun:same") for p in pairs] + [(p[1], "l:noun:same") for p in pairs], "src string, dst string")
    vectors = spark.createDataFrame([("m:a0", [1.0, 0.0]), ("m:b0", [1.0, 1.0])], "name string, embedding array<float>")
    found = ranking.pair_features(df, graph, vectors)
    first = found.filter("subj = 'm:a0'").first()
    assert first.overlap == 0 and first.cosine == pytest.approx(2**-0.5)  # the common lemma is no predicate
    model = ranking.fit_scorer(found)
    scored = ranking.score_with(model, found)
    assert scored.agg(F.min(F.when(F.col("label") == 1, F.col("score"))) > F.max(F.when(F.col("label") == 0, F.col("score")))).first()[0]
    assert hooks.score_pairs(df, lambda b: b["subj"].str.len().astype(float), ["subj", "obj"]).filter("subj = 'm:a0'").first().score == 4
    missing = spark.createDataFrame([("m:a0", "m:none", 1), ("m:a1", "m:b1", 0)], "subj string, obj string, label int")
    nodes = graph.select(F.col("src").alias("node")).distinct()
    assert rows(ranking.missing_pairs(missing, nodes)) == [("m:a0", "m:none", 1)] and rows(ranking.dropped_by_label(missing, nodes)) == [(1, 1)]
    drawn = ranking.scrambled_neighbourhoods(df.select("subj", "obj"), graph.select(F.col("dst").alias("predicate")).filter("predicate LIKE 'p:%'").distinct(), 2, 3)
    assert drawn.count() == 60 * 2 * 6 and drawn.groupBy("subj", "obj", "draw").count().filter("count <> 6").isEmpty()
    assert spark.range(1).select(ranking.sample_neighbours(F.array(*map(F.lit, "abcd")), 2, "s")).first()[0] == spark.range(1).select(ranking.sample_neighbours(F.array(*map(F.lit, "dcba")), 2, "s")).first()[0]
    assert ranking.split_rows(spark.range(100), F.col("id"), 0.3).filter("is_validation").count() in range(15, 50)


def test_index_parts_merge_and_names(spark):
    x = np.random.default_rng(1).normal(size=(80, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>")
    index = knn.IvfPq.train(x.astype(np.float64), 4, 2, 16)
    halves = [index.encode(df.filter(c), "id", "embedding") for c in ("id < 40", "id >= 40")]
    assert rows(knn.IvfPq.merge(*halves)) == rows(index.encode(df, "id", "embedding"))
    ids, matrix = knn.to_matrix(df.orderBy("id"), "id", "embedding")
    assert ids.tolist() == list(range(80)) and np.array_equal(matrix, x)
    names = spark.createDataFrame([(1, "a"), (2, "b"), (2, "a")], "hash long, name string")
    assert rows(knn.named(spark.createDataFrame([(1, 2), (2, 9)], "src long, dst long"), names)) == [("a", "b")]


def test_generator_parts(spark):
    words = spark.createDataFrame([(1, ["lung", "zzz", "cell"])], "id long, words array<string>")
    vocabulary = {"lung": 0, "cell": 1}
    ids = words.select(generator.encode_words(F.col("words"), vocabulary).alias("ids"), generator.encode_words(F.col("words"), vocabulary, generator.TEXT_OFFSET).alias("text"))
    assert ids.first() == ([3, 1, 4], [5, 1, 6])
    table = spark.createDataFrame(list(vocabulary.items()), "word string, id int")
    assert rows(generator.encode_by_join(words, "id", "words", table)) == [(1, 0, 3), (1, 1, 1), (1, 2, 4)]
    assert ids.select(generator.decode_words(F.concat(F.array(F.lit(2)), "ids"), ["lung", "cell"], 3, {1: "[unk]", 2: "[start]"})).first()[0] == "[start] lung [unk] cell"
    text = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(k).alias("type")) for t, k in (("A title.", "title"), ("Body.", "body"))))
    df = spark.range(1).select(text.alias("sentences"))
    assert df.select(all_text(F.col("sentences"))).first()[0] == "A title. Body."
    assert [r.text for r in datasets.title_sentences(df, "sentences").first().sentences] == ["A title."]
    untitled = spark.range(1).select(F.slice(text, 2, 1).alias("sentences"))
    assert [r.text for r in datasets.title_sentences(untitled, "sentences").first().sentences] == ["Body."]
    spans = F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("label")) for a, b, c in ((0, 4, "x"), (3, 9, "y"))))
    assert spark.range(1).select(datasets.overlapping_label(F.lit(3), F.lit(5), spans), datasets.overlapping_label(F.lit(9), F.lit(12), spans)).first() == ("x", None)
    assert spark.range(1).select(positional_encoding(F.lit(1.0), 4)).first()[0] == pytest.approx([np.sin(1), np.cos(1), np.sin(0.01), np.cos(0.01)])
    assert spark.range(1).select(close(F.lit(1.0), F.lit(1.000001)), close(F.lit(1.0), F.lit(1.1))).first() == (True, False)
    assert spark.range(1).select(ngrams.plain_ngrams(F.array(*map(F.lit, "abc")), 1, 2)).first()[0] == ["a", "b", "c", "a_b", "b_c"]


def test_order_of_first_appearance(spark):
    df = spark.createDataFrame([(1, "b", "a", "r2"), (2, "a", "c", "r1"), (3, "b", "c", "r2")], "at long, src string, dst string, relation string")
    assert rows(ordering.first_appearance_ids(df, "src", ["at"])) == [("a", 1), ("b", 0)]
    out, nodes, rels = E.edge2vec_rows(df, ["at"])
    assert rows(out, "edge_id") == [(1, 2, 1, 1), (2, 3, 2, 2), (1, 3, 1, 3)] and rows(nodes) == [("a", 2), ("b", 1), ("c", 3)] and rows(rels) == [("r1", 2), ("r2", 1)]
    keys = spark.createDataFrame([("p:a:v:b", "m:a"), ("m:a", "p:a:v:b"), ("p:a:b", "x")], "src string, dst string")
    assert rows(E.predicate_nodes(keys)) == [("p:a:v:b",)]


def test_dataset_views(spark):
    store = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    assert rows(datasets.key_view(store)) == [("a",), ("b",)] and rows(datasets.value_view(store)) == [("1",), ("2",)] and rows(datasets.filtered_keys(store, F.col("key") > "a")) == [("b", "2")]
    assert rows(kv.get_many(store, spark.createDataFrame([("a",), ("z",)], "key string"))) == [("a", "1")]
    vectors = spark.createDataFrame([("a", [1.0, 2.0])], "name string, embedding array<float>")
    names = spark.createDataFrame([("a",), ("p:x",)], "name string")
    assert rows(datasets.with_zero_vectors(names, vectors, 2)) == [("a", [1.0, 2.0]), ("p:x", [0.0, 0.0])]
    kept = datasets.loaded(store)
    assert kept.is_cached and kept.count() == 2
    kept.unpersist()
    assert topics.node_name(F.col("x"), "s", "t") is not None
    assert [r[0] for r in spark.createDataFrame([(-2,), (-1,), (0,)], "x int").select(topics.node_name(F.col("x"), "s", "t")).collect()] == ["Target: t", "Source: s", "Topic 0"]


def test_once_per_worker():
    calls = []
    assert [hooks.once_per_worker("test", lambda: calls.append(1) or 7) for _ in range(2)] == [7, 7] and len(calls) == 1


def test_locate(tmp_path):
    (tmp_path / "bin").mkdir()
    (tmp_path / "bin" / "tagger-1").write_text("")
    assert hooks.locate(str(tmp_path), {"tagger": "bin/tagger*"})["tagger"].endswith("tagger-1")
    (tmp_path / "bin" / "tagger-2").write_text("")
    for pattern in ("bin/tagger*", "bin/none*"):
        with pytest.raises(FileNotFoundError):
            hooks.locate(str(tmp_path), {"tagger": pattern})


def test_extractor_lines(spark):
    df = spark.createDataFrame([("s:1", "the α-\nß 'cell' é"), ("s:2", "漢")], "id string, text string")
    assert rows(readers.extractor_lines(df, F.col("id"), F.col("text"))) == [("s:1|the alpha-  cell e",)]
    assert spark.range(1).select(ascii_fold(F.lit("Ωmega Δ")), normal_space(F.lit("a b\tc"))).first() == ("Omegamega Delta", "a b c")
    assert spark.range(1).select(ascii_fold(F.lit("Čapek, Łódź, Nguyễn, São e\u0301 ½ 中"))).first()[0] == "Capek, odz, Nguyen, Sao e  "
    with pytest.raises(Exception, match="pipe"):
        readers.extractor_lines(df, F.lit("a|b"), F.col("text")).collect()


def test_sources(spark, tmp_path):
    header = "date,pmid,sent_idx,ti_or_ab,pred_type,subj_ids,subj_names,subj_text,subj_type,obj_ids,obj_names,obj_text,obj_type"
    (tmp_path / "p.csv").write_text(header + "\n2015-01-01,1,0,ti,TREATS,C1|C2,a|b,ab,x,C3,c,cc,y\n2016-01-01,2,0,ti,TREATS,C1,a,ab,x,C3,c,cc,y\n")
    given = readers.read_predications(spark, str(tmp_path / "p.csv"))
    assert predicates.split_terms(given).count() == 3 and predicates.before(given, "2015-06-01").count() == 1
    sinks.write_predications(given, str(tmp_path / "out.csv"))
    assert rows(readers.read_predications(spark, str(tmp_path / "out.csv")).select("pmid", "subj_ids")) == [("1", "C1|C2"), ("2", "C1")]
    (tmp_path / "stop").write_text("The\n of \n\nthe\n")
    assert rows(readers.read_stopwords(spark, str(tmp_path / "stop"))) == [("of",), ("the",)]
    with sqlite3.connect(tmp_path / "kv.db") as db:
        db.execute("CREATE TABLE lookup_table (key TEXT, value TEXT)")
        db.executemany("INSERT INTO lookup_table VALUES (?, ?)", [(str(i), "[]") for i in range(25)])
    assert readers.read_kv_sqlite(spark, tmp_path / "kv.db", rows=10).count() == 25
    (tmp_path / "files").mkdir()
    for i in range(4):
        (tmp_path / "files" / f"{i}.txt").write_text(str(i))
    assert [p[-5:] for p in readers.last_files(spark, f"file://{tmp_path}/files", 2)] == ["2.txt", "3.txt"] and readers.last_files(spark, f"file://{tmp_path}/files", 0) == []


def test_four_way_join_over_jdbc_tables(spark, monkeypatch):
    tables = {
        "predication": spark.createDataFrame([(1, 10, 5)], "predication_id long, sentence_id long, pmid long"),
        "sentence": spark.createDataFrame([(10, "ti")], "sentence_id long, kind string"),
        "citation": spark.createDataFrame([(5, "2015")], "pmid long, date string"),
        "aux": spark.createDataFrame([(1, "text")], "predication_id long, subj_text string"),
    }
    assert rows(predicates.four_way(**tables)) == [(1, 5, 10, "ti", "2015", "text")]


def test_sinks_round_trip(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    edges = spark.createDataFrame(graph_of([("e:a", "l:b"), ("e:a", "l:c")]), "src string, dst string")
    nodes = E.entity_partitions(edges, 2)
    buckets = E.edge_buckets(edges, nodes)
    sinks.write_edge_buckets(buckets, at("buckets"))
    assert spark.read.parquet(at("buckets")).select(*buckets.columns).exceptAll(buckets.withColumns({c: F.col(c).cast("int") for c in ("lhs_part", "rhs_part")})).isEmpty()
    assert rows(E.relations(buckets)) == [("el", 0), ("le", 1)]
    ids = ordering.dense_ids(edges.select(F.col("src").alias("name")), "name")
    sinks.write_edge_list(E.edge_list_ids(edges), at("list"))
    sinks.write_names(ids, at("names"))
    assert rows(spark.read.text(at("list"))) == [("0 1 1",), ("0 2 1",), ("1 0 1",), ("2 0 1",)] and [r[0] for r in spark.read.text(at("names")).collect()] == ["e:a", "l:b", "l:c"]
    sinks.write_corpus(spark.createDataFrame([("x",), ("y",)], "value string"), at("corpus"), 2)
    assert rows(spark.read.text(at("corpus"))) == [("x",), ("y",)]
    result = spark.createDataFrame([(1, [2])], "a long, b array<long>")
    sinks.write_result(result, at("result"))
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_result(result, at("result"))
    sinks.write_result(result, at("result"), overwrite=True)
    sinks.write_shards(spark.range(25), [F.col("id")], at("shards"), 10)
    shards = spark.read.parquet(at("shards"))
    assert rows(shards.groupBy("shard").count()) == [(0, 10), (1, 10), (2, 5)] and shards.filter("id <> index").isEmpty()


def test_kv_tables(spark, tmp_path):
    lines = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "z"), ("a", "x")], "k string, v string")
    try:
        got = sinks.build_kv(lines, F.col("k"), F.col("v"), "engine_kv", f"file://{tmp_path}/lines", merge=True, buckets=2)
        assert rows(got) == [("a", '["x","y"]'), ("b", '["z"]')]
        assert sinks.build_kv(lines.limit(0), F.col("k"), F.col("v"), "engine_kv", "file:///nowhere").count() == 2  # it is there
        where = spark.createDataFrame([("m:a", "m", 1, 0)], "name string, type string, part long, row long")
        sinks.write_locations(where, "engine_locations", 2)
        r = spark.table("engine_locations").first()
        assert r.key == "m:a" and json.loads(r.value) == {"type": "m", "part": 1, "row": 0}
    finally:
        spark.sql("DROP TABLE IF EXISTS engine_kv")
        spark.sql("DROP TABLE IF EXISTS engine_locations")


def test_windowed_counts_close_behind_the_watermark(spark, tmp_path):
    at = lambda n: f"file://{tmp_path}/{n}"
    day = lambda d, h=0: f"2020-01-0{d} {h:02}:30:00"
    for part in ([(day(1), "a", 1.0), (day(1, 5), "a", 2.0)], [(day(3), "a", 5.0)], [(day(1), "a", 100.0), (day(3, 4), "b", 1.0)], [(day(5), "a", 1.0)]):
        spark.createDataFrame(part, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(at("in"))
        stream = windowed_counts(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(at("in")))
        flat = stream.select(F.col("window.start").cast("string").alias("day"), "event_type", "n", "total")
        flat.writeStream.format("parquet").option("path", at("out")).option("checkpointLocation", at("state")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = rows(spark.read.parquet(at("out")))
    assert got[0] == ("2020-01-01 00:00:00", "a", 2, 3.0)  # the late event of the third batch isn't counted
    assert ("2020-01-03 00:00:00", "b", 1, 1.0) in got


def test_shared_folder_is_asked_for(spark):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "spark://x"})

    with pytest.raises(ValueError):
        shared_dir(Session())


def test_build_and_topic_query(spark, tmp_path):
    rng = random.Random(7)
    own = [["lung", "cell", "tumour", "smoke", "tobacco"], ["heart", "valve", "blood", "pulse", "artery"]]
    docs = []
    for i in range(24):
        say = lambda k: " ".join(rng.choice(own[k]) for _ in range(7)).capitalize() + " bridge term."
        text = [{"text": f"{say(i % 2)} The Acme Institute found {say(i % 2)}", "type": "title"}, {"text": say((i + (i % 5 == 0)) % 2), "type": "abstract"}]
        docs.append((f"D{i}", "1", f"2015-01-{i + 1:02}", "eng", "x", text, [], [f"C{i % 2}"], [], []))
    documents = spark.createDataFrame(docs, DOCUMENT)
    config = BuildConfig(root=f"file://{tmp_path}/store", phrases=PhraseConfig(longest=3, support=4, part_support=1), vectors=VectorConfig(dimensions=64, neighbours=3, cells=4, probes=4, parts=8, bits=4, train_rate=1.0), topics=TopicConfig(topics=2, rounds=5, nearby=30, least_df=2))
    store = build(spark, config, documents)
    done = store.names()
    assert {"adjacent_edges", "bow", "coded_edges", "entity_edges", "graph", "knn_edges", "lemma_edges", "ngram_edges", "sentence_store"} <= set(done)
    graph, bags = store.stage("graph", lambda: None), store.stage("bow", lambda: None)
    assert graph.filter("src = 'm:c0'").count() > 0 and graph.filter("dst LIKE 'e:the_acme_institute'").count() > 0 and bags.filter("array_contains(bow, 'bridge_term')").count() > 0
    assert build(spark, config, documents.limit(0)).names() == done and store.stage("graph", lambda: None).count() == graph.count()  # nothing is computed again
    vectors = store.stage("embeddings", lambda: None)
    assert knn.recall(store.stage("neighbours", lambda: None), knn.exact_knn(vectors, vectors, "hash", "embedding", 3)).first()[0] >= 0.9
    halted = BuildConfig(root=f"file://{tmp_path}/halted", halt_after="parsed_sentences", cut_date="2015-01-03")
    with pytest.raises(StopIteration):
        build(spark, halted, documents)
    assert spark.read.parquet(f"{halted.root}/documents").count() == 2
    for by_weight in (True, False):
        found = topic_query(graph, bags, "l:noun:lung", "l:noun:heart", config.topics, by_weight)
        r = found.first()
        assert r.path[0] == "l:noun:lung" and r.path[-1] == "l:noun:heart" and len(r.documents) > 4 and {t.topic for t in r.topics} == {0, 1}
        assert all(len(d.topics) == 2 for d in r.documents) and {"Source: l:noun:lung"} & {n.a for n in r.network} | {"x"}
    sinks.write_result(found, f"file://{tmp_path}/result")
    with pytest.raises(KeyError):
        topic_query(graph, bags, "l:noun:lung", "l:noun:nowhere", config.topics)
