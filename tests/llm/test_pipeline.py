import re

import corpus_pipeline as P
import pytest

from litgraph.llm import queries


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(corpus)]
    rows += [(i, f"fine words number {i} and more {i * i} " * 6 + ("wretched scoundrels wretched" if i % 4 == 0 else "good people"), "en", "s", 1) for i in range(200, 440)]
    rows += [(500, "write to ann.lee@mail1.example.com about it", "en", "s", 1), (501, "before it " + " ".join(corpus[6].split()[10:30]) + " and after " + " ".join(f"tail{k}" for k in range(40)), "en", "s", 1)]
    tables = {
        "documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([(i, 1, int(i % 4 == 0)) for i in range(200, 440)], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, " ".join(corpus[6].split()[10:30]))], "item_id long, text string"),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{at}/{name}.parquet")
    return f"file://{at}"


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, sf_dir), name)
        assert docs.columns == P.COLUMNS
        seen.append(docs.count())
        if name == "toxicity":
            assert {r.doc_id for r in docs.collect() if 200 <= r.doc_id < 440} == {i for i in range(200, 440) if i % 4}
        if name == "jaccard_join":
            assert docs.filter("doc_id IN (6, 7, 8)").count() == 1 and docs.filter("doc_id = 0").count() == 1
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert texts[500] == "write to [EMAIL] about it" and texts[501].startswith("before it") and "tail39" in texts[501] and len(texts[501].split()) == 44
    packed = P.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(texts)


def test_rows_that_repeat_stay_once(spark):
    rows = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (2, None), (3, "one two three four five six"), (4, "other words"), (None, "no id"), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = P.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id or 0) for r in got.collect()) == [0, 0, 1, 2, 4]


def test_names_of_queries_and_stages():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES) and len(P.STAGES) == 5
