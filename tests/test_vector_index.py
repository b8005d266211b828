"""Exact search and the index against brute force, at the survey's settings and at two sizes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.operators import knn, vector_index
from litgraph.operators.vector_index import VectorIndex, k_means


def clustered(n, width, clusters, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(clusters, width))
    return (centers[rng.integers(0, clusters, n)] + 0.5 * rng.normal(size=(n, width))).astype(np.float32)


def frame(spark, x, parts=3):
    return spark.createDataFrame([(f"v{i:05}", v.tolist(), "more") for i, v in enumerate(x)], "name string, embedding array<float>, cell string").repartition(parts)


def plain_neighbours(x, queries, k):
    d = ((x[None].astype(np.float64) - x[queries][:, None].astype(np.float64)) ** 2).sum(2).round(9)
    out = set()
    for i, q in enumerate(queries):
        order = [j for j in np.argsort(d[i], kind="stable").tolist() if j != q][:k]
        out |= {(f"v{q:05}", f"v{j:05}", r, d[i][j]) for r, j in enumerate(order, 1)}
    return out


def test_exact_search_in_blocks(spark):
    x = clustered(150, 6, 4, 1)
    x[20:30] = x[3]  # ties go to the first name
    df = frame(spark, x).unionByName(spark.createDataFrame([("none", None, "")], "name string, embedding array<float>, cell string"))
    got = knn.exact_knn(df.filter("name < 'v00040' or name = 'none'"), df, "name", "embedding", 4, most_rows=40, most_queries=9)
    assert {(r.src, r.dst, r["rank"], r.dist) for r in got.collect()} == plain_neighbours(x, range(40), 4)
    few = frame(spark, x[:3])
    assert knn.exact_knn(few, few, "name", "embedding", 10).count() == 6 and knn.exact_knn(few.limit(0), few, "name", "embedding", 10).count() == 0
    plan = knn.exact_knn(df, df, "name", "embedding", 4)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_at_two_sizes(spark, n):
    df = frame(spark, clustered(n, 32, 30, n)).drop("cell")
    index = VectorIndex.train(df, "name", "embedding", parts=8, bits=8)
    assert len(index.centers) == round(n**0.5)
    coded = index.encode(df, "name", "embedding").cache()
    assert coded.count() == n and coded.filter(F.length("code") != 8).count() == 0
    queries = df.filter("name like '%7'")
    exact = knn.exact_knn(queries, df, "name", "embedding", 10)
    probes = index.learn_probes(coded, "name", 10)
    found = index.search(coded, queries, "name", "embedding", 10, probes).cache()
    assert knn.recall(found, exact).first()[0] >= 0.9 and probes < len(index.centers)
    assert found.count() == queries.count() * 10 and found.filter("src = dst").count() == 0
    whole = {(r.src, r.dst): r.dist for r in exact.collect()}
    assert all(whole[r.src, r.dst] == pytest.approx(r.dist, abs=1e-6) for r in found.collect() if (r.src, r.dst) in whole)


def test_the_surveys_defaults(spark):
    df = frame(spark, clustered(5000, 96, 60, 9)).drop("cell")
    index = VectorIndex.train(df, "name", "embedding", cells=2048, parts=96, bits=8, rounds=4)
    assert len(index.centers) == 2048 and len(index.books) == 96 and all(len(b) == 256 for b in index.books)
    coded = index.encode(df, "name", "embedding")
    queries = df.filter("name like '%50'")
    exact = knn.exact_knn(queries, df, "name", "embedding", 10)
    assert knn.recall(index.search(coded, queries, "name", "embedding", 10, index.learn_probes(coded, "name", 10)), exact).first()[0] >= 0.9


def test_an_index_repeats_merges_and_comes_back(spark, tmp_path):
    df = frame(spark, clustered(600, 12, 8, 5)).drop("cell")
    index = VectorIndex.train(df, "name", "embedding", cells=9, parts=4, bits=5)
    again = VectorIndex.train(df.repartition(7), "name", "embedding", cells=9, parts=4, bits=5)
    assert np.array_equal(index.centers, again.centers) and all(np.array_equal(a, b) for a, b in zip(index.books, again.books, strict=True))
    index.save(spark, f"file://{tmp_path}/index")
    back = VectorIndex.load(spark, f"file://{tmp_path}/index")
    assert np.array_equal(index.centers, back.centers) and all(np.array_equal(a, b) for a, b in zip(index.books, back.books, strict=True))
    halves = index.encode(df.filter("name < 'v00300'"), "name", "embedding").unionByName(back.encode(df.filter("name >= 'v00300'"), "name", "embedding"))
    index.write(halves, f"file://{tmp_path}/codes")
    stored = spark.read.parquet(f"file://{tmp_path}/codes")
    key = lambda rows: sorted((r.name, r.cell, bytes(r.code)) for r in rows.collect())
    assert key(stored) == key(index.encode(df, "name", "embedding"))
    assert "PushedFilters: [IsNotNull(cell), EqualTo(cell,3)]" in stored.filter("cell = 3")._jdf.queryExecution().toString()
    x = np.array([r.embedding for r in df.orderBy("name").collect()], np.float64)
    cells = ((x[:, None] - index.centers[None]) ** 2).sum(2).argmin(1)
    assert [r.cell for r in halves.orderBy("name").collect()] == cells.tolist()


def test_blocks_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 50)
    monkeypatch.setattr(vector_index, "QUERIES", 30)
    df = frame(spark, clustered(500, 8, 2, 6)).drop("cell")
    index = VectorIndex.train(df, "name", "embedding", cells=4, parts=2, bits=4)
    coded = index.encode(df, "name", "embedding")
    found = index.search(coded, df.filter("name < 'v00100'"), "name", "embedding", 5, probes=4, candidates=500)
    exact = knn.exact_knn(df.filter("name < 'v00100'"), df, "name", "embedding", 5)
    pairs = lambda rows: {(r.src, r.dst, r["rank"]) for r in rows.collect()}
    assert pairs(found) == pairs(exact)


def test_settings_are_kept_or_refused(spark):
    df = frame(spark, clustered(40, 12, 3, 7)).drop("cell")
    for settings in ({"parts": 5}, {"bits": 17}, {"cells": 41}):
        with pytest.raises(ValueError):
            VectorIndex.train(df, "name", "embedding", **settings)
    with pytest.raises(ValueError):
        VectorIndex.train(df.limit(0), "name", "embedding")
    wide = VectorIndex.train(df, "name", "embedding", cells=3, parts=3, bits=9)
    assert not wide.wide and VectorIndex(wide.centers, [np.zeros((300, 4))] * 3).wide
    code = VectorIndex(wide.centers, [np.arange(1200.0).reshape(300, 4)] * 3).encode(df, "name", "embedding").first().code
    assert len(code) == 6


def test_empty_cells_start_again(spark):
    rows = [([float(i % 2), 0.0], i) for i in range(40)] + [([5.0 + i / 100, 1.0], 100 + i) for i in range(4)]
    sample = spark.createDataFrame(rows, "vector array<double>, h long")
    assert len(np.unique(k_means(sample, 5, 6, 5.03), axis=0)) == 5
