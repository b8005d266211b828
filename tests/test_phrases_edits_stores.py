"""Level-wise phrases, edit-distance joins, key-value stores as a source, and stages that resume within themselves."""

import collections
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from litgraph.functions.text import STOPWORDS
from litgraph.operators import edit_join, ngrams, phrases
from litgraph.plans.stage import StageStore
from litgraph.sources.kv_source import read_kv_stores


@pytest.fixture(scope="module")
def lists(spark):
    rng = random.Random(3)
    vocabulary = ["lung", "cell", "heart", "quickly", "valve", "tumour", *STOPWORDS[:3]]
    rows = [(i, [rng.choice(vocabulary) if rng.random() < 0.8 else f"rare{rng.randrange(60)}" for _ in range(rng.randrange(0, 40))]) for i in range(80)]
    rows += [(100, None), (101, []), (102, ["lung"]), (103, ["lung", "cell"]), (104, ["lung", "of", "cell"] * 3000), (None, ["heart", "valve"])]
    return rows, spark.createDataFrame(rows, "doc long, lemmas array<string>").repartition(3).cache()


def plain_phrases(rows, support):
    good = lambda w: w not in STOPWORDS and not w.endswith(("ly", "ment"))
    n = collections.Counter("_".join(w[i : i + k]) for _, w in rows for k in (2, 3) for i in range(len(w or ()) - k + 1) if good(w[i]) and good(w[i + k - 1]))
    return {p: c for p, c in n.items() if c >= support}


def plain_marks(words, model):
    at, out = 0, []
    while at < len(words or ()):
        width = next((k for k in (3, 2) if at + k <= len(words) and "_".join(words[at : at + k]) in model), 1)
        out += ["_".join(words[at : at + width])] if width > 1 else []
        at += width
    return out


@pytest.mark.parametrize("support", [1, 4, 25])
def test_phrases_equal_plain_counts(spark, lists, support, monkeypatch):
    rows, df = lists
    monkeypatch.setattr(phrases, "HELD", 50)
    model, want = phrases.mine(df, "lemmas", support), plain_phrases(rows, support)
    assert {r.ngram: r.n for r in model.table(spark).collect()} == want
    got = {r.doc: r.ngrams for r in model.annotate(df, "doc", "lemmas").collect()}
    assert got == {i: plain_marks(w, want) for i, w in rows}


def test_models_too_large_to_broadcast_are_joined(lists, monkeypatch):
    rows, df = lists
    want = plain_phrases(rows, 4)
    for name, value in (("MOST", 3), ("BITS", 2)):
        monkeypatch.setattr(phrases, name, value)
        assert phrases.mine(df, "lemmas", 4) is None
        got = {r.doc: r.ngrams for r in phrases.mined_and_annotated(df.filter("doc IS NOT NULL"), "doc", "lemmas", 4).collect()}
        assert got == {i: plain_marks(w, want) for i, w in rows if i is not None}
        monkeypatch.undo()


def test_phrases_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, ["a"])], "doc long, lemmas array<string>")
    assert phrases.mine(df, "lemmas", 1).table(spark).count() == 0 and {r.doc: r.ngrams for r in phrases.mined_and_annotated(df, "doc", "lemmas", 9).collect()} == {1: [], 2: []}
    plan = phrases.Phrases.annotate(phrases.mine(df, "lemmas", 1), df, "doc", "lemmas")._jdf.queryExecution().toString()
    assert "Exchange" not in plan and ngrams is not None


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_closest_texts_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    texts = [word(rng.randrange(0, 14)) for _ in range(120)] + ["", "ünïcödé", "a" * 30]
    asked = [rng.choice(texts) for _ in range(10)]
    for _ in range(60):
        q = list(rng.choice(texts))
        for _ in range(rng.randrange(0, 5)):
            at = rng.randrange(len(q) + 1)
            q[at : at + rng.randrange(2)] = rng.choice(["", "a", "bc"])
        asked.append("".join(q))
    asked += ["", "zzzzzzzzzzzzzzzzzzzz", "unicode"]
    q, t = spark.createDataFrame([(x,) for x in [*asked, None, asked[0]]], "query string"), spark.createDataFrame([(x,) for x in [*texts, None, texts[0]]], "text string")
    want = set()
    for x in set(asked):
        d = {y: distance(x, y) for y in set(texts)}
        want |= {(x, y, k) for y, k in d.items() if k == min(d.values())}
    got = edit_join.closest_pairs(q, t).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_each_radius_is_complete_and_no_cross_join(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(0, 8))) for _ in range(70)})
    q, t = spark.createDataFrame([(x,) for x in words], "query string"), spark.createDataFrame([(x,) for x in words], "text string")
    for r in (1, 3):
        found = edit_join.within(q, t, r)
        assert {tuple(x) for x in found.collect()} == {(a, b, distance(a, b)) for a in words for b in words if distance(a, b) <= r}
        plan = found._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert edit_join.closest_pairs(q, t.limit(0)).count() == 0 and edit_join.closest_pairs(q.limit(0), t).count() == 0


@pytest.fixture
def stores(tmp_path):
    for k in range(2):
        with sqlite3.connect(tmp_path / f"s{k}.db") as db:
            db.execute("CREATE TABLE lookup_table (key TEXT PRIMARY KEY, value TEXT)")
            db.executemany("INSERT INTO lookup_table VALUES (?, ?)", [(f"k{k}:{i:03}", f"[{i}]") for i in range(250)])
    with sqlite3.connect(tmp_path / "odd.sqlite3") as db:
        db.execute("CREATE TABLE own (name TEXT, neighbours TEXT)")
        db.execute("INSERT INTO own VALUES ('x', '1'), ('y', NULL)")
    return tmp_path


def test_stores_are_read_by_ranges(spark, stores):
    df = read_kv_stores(spark, f"{stores}/s*.db", rows="100")
    assert df.rdd.getNumPartitions() == 6 and {(r.key, r.value) for r in df.collect()} == {(f"k{k}:{i:03}", f"[{i}]") for k in range(2) for i in range(250)}
    own = read_kv_stores(spark, f"file://{stores}/odd.sqlite3", table="own", key="name", value="neighbours")
    assert sorted((r.key, r.value) for r in own.collect()) == [("x", "1"), ("y", None)]
    assert read_kv_stores(spark, f"{stores}/s0.db", table="elsewhere", key="node").count() == 250  # the usual names


def test_filters_on_keys_go_down(spark, stores):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_kv_stores(spark, f"{stores}/s*.db")
        for condition, n in (("key = 'k1:007'", 1), ("key IN ('k0:001', 'k1:002', 'no')", 2), ("key LIKE 'k0:01%'", 10), ("key = 'k0:001' AND value = '[1]'", 1), ("value = '[3]'", 2)):
            assert df.filter(condition).count() == n
        plan = df.filter("key = 'k1:007'")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Filter") == plan.count("RuntimeFilters")
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_stores_of_a_wrong_kind_are_errors(spark, stores):
    with sqlite3.connect(stores / "bad.db") as db:
        db.execute("CREATE TABLE lookup_table (key INTEGER, value TEXT)")
    for path, said in ((f"{stores}/bad.db", "key is INTEGER"), (f"{stores}/odd.sqlite3", "no table lookup_table"), (f"{stores}/none.db", "no store")):
        with pytest.raises(Exception, match=said):
            read_kv_stores(spark, path).collect()
    with pytest.raises(Exception, match="one column"):
        read_kv_stores(spark, f"{stores}/s0.db", key="a", value="a").collect()


def test_a_stage_goes_on_where_it_was_killed(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    spark.range(700).repartition(7).write.parquet(source)
    rows, seen = spark.read.parquet(source), []

    def work(fail_at):
        def compute(part):
            seen.append(sorted(r.id for r in part.collect()))
            if len(seen) == fail_at:
                raise RuntimeError("lost")
            return part.withColumn("twice", F.col("id") * 2)

        return compute

    store = StageStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(RuntimeError):
        store.stage_by_files("doubled", rows, work(3), 4)
    assert not store.done("doubled") and sum(store.done(f"doubled/resume_part={k}") for k in range(4)) == 2
    lost, seen[:] = seen[2], []
    out = store.stage_by_files("doubled", rows, work(0), 4)
    assert len(seen) == 2 and seen[0] == lost and store.done("doubled")
    assert sorted((r.id, r.twice) for r in out.collect()) == [(i, 2 * i) for i in range(700)] and out.columns == ["id", "twice"]
    seen.clear()
    assert store.stage_by_files("doubled", rows, work(0), 4).count() == 700 and not seen


def test_a_changed_file_makes_its_part_anew(spark, tmp_path):
    source = f"file://{tmp_path}/source"
    spark.range(300).repartition(3).write.parquet(source)
    store, calls = StageStore(spark, f"file://{tmp_path}/store"), []

    def compute(part):
        calls.append(part.count())
        if len(calls) == 3:
            raise RuntimeError("lost")
        return part

    with pytest.raises(RuntimeError):
        store.stage_by_files("copy", spark.read.parquet(source), compute, 3)
    spark.range(300, 310).coalesce(1).write.mode("append").parquet(source)
    assert store.stage_by_files("copy", spark.read.parquet(source), lambda p: calls.append(0) or p, 3).count() == 310
    assert calls.count(0) >= 1
