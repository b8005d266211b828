"""Topics whose words stay in a table: the arithmetic, a planted corpus, repeats, and what reaches the driver."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.operators import topic_model as T


def corpus(seed, docs, vocabulary):
    """Documents about one of three subjects, each with words of its own."""
    rng = random.Random(seed)
    rows = [(i, f"doc{i}", [f"w{i % 3}_{rng.randrange(vocabulary)}" if rng.random() < 0.9 else f"all{rng.randrange(20)}" for _ in range(40)]) for i in range(docs)]
    return rows + [(docs, "none", None), (docs + 1, "empty", []), (docs + 2, "strange", ["once"])]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(corpus(1, 90, 15), "id long, name string, bow array<string>").repartition(4).cache()


def test_digamma():
    x = np.array([1e-3, 0.5, 1.0, 2.0, 7.5, 300.0])
    slope = [(math.lgamma(v + 1e-6 * v) - math.lgamma(v - 1e-6 * v)) / (2e-6 * v) for v in x]
    assert T.digamma(x) == pytest.approx(slope, rel=1e-4) and T.digamma(1.0) == pytest.approx(-0.5772156649)


def test_a_block_equals_plain_loops():
    rng = np.random.default_rng(2)
    beta, bags = rng.random((4, 3)), [["a", "b", "a"], [], ["d", "x"]]
    doc, word, n = T.postings(bags, {w: i for i, w in enumerate("abcd")})
    assert list(zip(doc.tolist(), word.tolist(), n.tolist())) == [(0, 0, 2.0), (0, 1, 1.0), (2, 3, 1.0)]
    gamma, added = T.fit_block(doc, word, n, beta, 3, 0.1)
    for d, bag in enumerate([{0: 2, 1: 1}, {}, {3: 1}]):
        g = [1.0] * 3
        for _ in range(400):
            theta = [math.exp(float(T.digamma(x) - T.digamma(sum(g)))) for x in g]
            g = [0.1 + theta[k] * sum(c * beta[w, k] / sum(theta[j] * beta[w, j] for j in range(3)) for w, c in bag.items()) for k in range(3)]
        assert gamma[d] == pytest.approx(g, abs=0.05)
    assert added.sum() == pytest.approx(4) and (added[2] == 0).all()


def test_planted_topics_are_found(frame):
    mixes, terms = T.fit_topics(frame, "bow", 3, 6, seed=5)
    rows = {r.id: r for r in mixes.collect()}
    assert set(mixes.columns) == {"id", "name", "bow", "topics"} and len(rows) == 93
    best = {s: {int(np.argmax(rows[i].topics)) for i in range(s, 90, 3)} for s in range(3)}
    assert all(len(b) == 1 for b in best.values()) and len(set.union(*best.values())) == 3
    assert all(sum(rows[i].topics) == pytest.approx(1) for i in range(90)) and all(sum(rows[i].topics) == 0 for i in (90, 91, 92))
    words = {}
    for r in terms.collect():
        words.setdefault(r.topic, []).append(r.word)
    assert terms.schema.simpleString() == "struct<topic:int,word:string,weight:double>" and sorted(map(len, words.values())) == [10, 10, 10]
    assert sorted({w.split("_")[0] for w in own} for own in words.values()) == [{"w0"}, {"w1"}, {"w2"}]


def test_equal_seeds_give_equal_topics(frame):
    key = lambda terms: sorted(map(tuple, terms.collect()))
    one, two, other = (key(T.fit_topics(df, "bow", 3, 3, seed)[1]) for df, seed in ((frame, 5), (frame.repartition(7), 5), (frame, 6)))
    assert one == two and one != other


def test_as_likely_as_the_library_of_spark(frame):
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer
    from pyspark.ml.functions import vector_to_array

    model, rows, needs = T.train_topics(frame, "bow", 3, 12)
    own = T.log_likelihood(model, rows, "bow", needs)
    bags = frame.filter(F.size("bow") > 1)
    vector = CountVectorizer(inputCol="bow", outputCol="v", minDF=2).fit(bags)
    lda = LDA(k=3, maxIter=12, seed=7, featuresCol="v").fit(vector.transform(bags))
    beta = lda.topicsMatrix().toArray()
    beta = beta / beta.sum(axis=0)
    total = n = 0.0
    for r in lda.transform(vector.transform(bags)).select(vector_to_array("v").alias("v"), vector_to_array("topicDistribution").alias("t")).collect():
        v = np.array(r.v)
        total, n = total + (v * np.log(beta @ np.array(r.t))).sum(), n + v.sum()
    assert own >= total / n - 0.02


def test_the_driver_sees_no_vocabulary(spark, monkeypatch):
    seen = []
    real = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: seen.append(rows := real(self)) or rows)
    for vocabulary in (20, 200):
        seen.clear()
        docs = spark.createDataFrame(corpus(3, 60, vocabulary), "id long, name string, bow array<string>")
        model, _, _ = T.train_topics(docs, "bow", 2, 1, least_df=1)
        assert max(map(len, seen), default=0) <= 2 and model.words.count() > vocabulary


def test_no_documents_or_no_words(spark):
    for rows in ([], [(1, "a", None), (2, "b", ["x"])]):
        mixes, terms = T.fit_topics(spark.createDataFrame(rows, "id long, name string, bow array<string>"), "bow", 2, 2)
        assert mixes.count() == len(rows) and terms.count() == 0


def test_rounds_move_numbers_only(frame):
    """Bags are packed once; a block's row has no text, and neither has what the rounds join."""
    _, packed = T.dealt(frame, "bow", 3)
    blocks = T.train_topics(frame, "bow", 3, 1)[2]
    assert not [t for _, t in blocks.needs.dtypes if "string" in t]
    bags = {tuple(sorted(b)) for (b,) in frame.select("bow").collect() if b}
    seen = set()
    for row in packed.toArrow().to_batches():
        for i in range(row.num_rows):
            one = T.pa.Table.from_batches([row.slice(i, 1)])
            words, (rows, doc, place, n) = one.column("words")[0].as_py(), T.unpack(one)
            seen |= {tuple(sorted(w for d, p, c in zip(doc, place, n) if d == x for w in [words[p]] * int(c))) for x in range(len(rows))} - {()}
    assert seen == bags
