"""Tables that go at a scope's end, settings that stay, and predications over JDBC from an embedded database."""

import uuid

import pytest
from pyspark.sql import functions as F

from litgraph.plans.stage import StageStore, scope, scratch, shared_dir
from litgraph.sources.readers import read_predications_jdbc


def exists(spark, df):
    path = spark._jvm.org.apache.hadoop.fs.Path(df.path_)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def test_a_scope_deletes_what_it_made(spark):
    outside = scratch(spark.range(3))
    with scope() as made:
        one, two = scratch(spark.range(4)), scratch(spark.range(5))
        with scope():
            inner = scratch(spark.range(6))
        assert not exists(spark, inner) and exists(spark, one)
        made.remove(two)
    assert [exists(spark, t) for t in (outside, one, two)] == [True, False, True] and two.count() == 5
    with pytest.raises(RuntimeError), scope():
        lost = scratch(spark.range(2))
        raise RuntimeError
    assert not exists(spark, lost)


def test_a_stage_leaves_only_itself(spark, tmp_path):
    kept = []

    def compute():
        kept.append(scratch(spark.range(10).withColumn("x", F.col("id") * 2)))
        return kept[0].filter("x > 5")

    assert StageStore(spark, f"file://{tmp_path}").stage("one", compute).count() == 7 and not exists(spark, kept[0])


def test_the_sessions_settings_stay(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    at = shared_dir(spark)
    assert shared_dir(spark) == at and spark.conf.get("spark.checkpoint.dir", None) == before

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf, sparkContext = Conf(), type("C", (), {"master": "local"})()

    assert shared_dir(Session()).startswith("file://")


def test_predications_over_jdbc(spark):
    options = {"url": f"jdbc:derby:memory:{uuid.uuid4().hex};create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    tables = {
        "predication": (range(1, 9), lambda i: (i, 10 + i, 5), "predication_id long, sentence_id long, pmid long"),
        "sentence": (range(1, 9), lambda i: (10 + i, i % 2), "sentence_id long, kind int"),
        "citation": (range(1), lambda _: (5, 2015), "pmid long, pyear int"),
        "aux": (range(1, 8), lambda i: (i, i * i), "predication_id long, score int"),
    }
    for name, (ids, row, schema) in tables.items():
        spark.createDataFrame([row(i) for i in ids], schema).write.format("jdbc").options(dbtable=name, **options).save()
    whole = read_predications_jdbc(spark, options["url"], {n: n for n in tables}, driver=options["driver"])
    assert sorted((r.predication_id, r.kind, r.pyear, r.score) for r in whole.collect()) == [(i, i % 2, 2015, i * i) for i in range(1, 8)]
    some = read_predications_jdbc(spark, options["url"], {n: n for n in tables}, limit=3, driver=options["driver"])
    assert some.count() == 3 and some.exceptAll(whole).isEmpty()
    assert "ReadSchema: struct<predication_id:bigint,score:int>" in whole.select("predication_id", "score")._jdf.queryExecution().executedPlan().toString()
