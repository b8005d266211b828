import pytest
from pyspark.sql import functions as F

from litgraph.operators import hooks
from litgraph.plans.config import BuildConfig, get_field, load, without_paths
from litgraph.sources import datasets


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"language": "ger", "topics": {"rounds": 9}}')
    c = load(BuildConfig, str(tmp_path / "c.json"), ["--topics.rounds", "3", "--vectors.train_rate", "0.5"])
    assert (c.language, c.topics.rounds, c.vectors.train_rate, get_field(c, "sentences.min_chars")) == ("ger", 3, 0.5, 10)
    (tmp_path / "bad.json").write_text('{"topics": {"nothing": 9}}')
    with pytest.raises(AttributeError):
        load(BuildConfig, str(tmp_path / "bad.json"))
    assert without_paths({"a_db": 1, "b": 2, "c": tmp_path}) == {"b": 2}


def test_hooks(spark):
    df = spark.createDataFrame([(1, "Lung cells of mice"), (2, "")], "id long, text string")
    own = hooks.analyse(df, "text").select("id", F.transform("tokens", lambda t: t["lemma"]).alias("words"))
    vectors = {r.id: r.embedding for r in hooks.embed(own, "id", "words", 16).collect()}
    assert sum(vectors[1]) == 4 and sum(vectors[2]) == 0
    piped = hooks.pipe_lines(spark.createDataFrame([("a",), ("b",)], "value string"), "cat").collect()
    assert sorted((r.line, r.output, r.error) for r in piped) == [("a", "a", None), ("b", "b", None)]
    assert hooks.pipe_lines(spark.createDataFrame([("a",)], "value string"), "false").first().error


def test_datasets(spark):
    df = spark.range(1000)
    n = datasets.two_level_sample(df, F.col("id") % 10, F.col("id"), 0.5, 0.5).count()
    assert 50 < n < 450
    assert datasets.numbered(spark.range(5), [F.desc("id")]).filter("index = 0").first().id == 4
    vectors = spark.createDataFrame([("a", [1.0])], "name string, embedding array<float>")
    assert datasets.with_vectors(spark.createDataFrame([("a",)], "name string"), vectors).count() == 1
    with pytest.raises(Exception, match="no vector"):
        datasets.with_vectors(spark.createDataFrame([("z",)], "name string"), vectors).collect()
