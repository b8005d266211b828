"""Operators with trained models: held-out quality, brute-force parts, edge cases."""

import collections
import math
import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from litgraph.llm import ann, boosting, langid, lanes, lm_score, toxicity

EMPTY = "doc_id long, text string"
SYLLABLES = {"en": "the ing er and th on re", "de": "ein sch der ung ch be keit", "fr": "eau que le es ai on eux"}


def text_in(lang, rng, n):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_lanes_place_every_step():
    rng = np.random.default_rng(0)
    lengths = rng.integers(0, 30, 40)
    own = lanes.Lanes(lengths, 7)
    values = np.arange(lengths.sum())
    grid = own.place(values, -1)
    assert (own.collect(grid) == values).all() and own.starts.sum() == (lengths > 0).sum()
    assert [int((grid[t] >= 0).sum()) for t in range(own.steps)] == own.active.tolist()


def test_language_model(spark, documents, corpus):
    rng = random.Random(5)
    texts = corpus + [text_in("en", rng, 150) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), EMPTY).withColumn("n_tokens", F.lit("clash")).repartition(3)
    got = {r.doc_id: r for r in lm_score.score_documents(docs, "doc_id").collect()}
    seqs = [[*brute.tokens(t), ""] for t in texts]
    count = collections.Counter(w for i, s in enumerate(seqs) if zlib.crc32(str(i).encode()) % 7 != 2 for w in s)
    n, v = sum(count.values()), len(count)
    for i, s in enumerate(seqs):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(s), sum(count[w] > 0 for w in s), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in s)) and r.score < 0
    held = [i for i in range(len(corpus), len(texts)) if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)
    assert lm_score.score_documents(docs.limit(0), "doc_id").count() == 0


def test_language_model_beyond_the_head(spark, corpus, monkeypatch):
    monkeypatch.setattr(lm_score.head_tokens, "__defaults__", (50,))
    docs = spark.createDataFrame(list(enumerate(corpus)), EMPTY)
    few = {r.doc_id: r for r in lm_score.score_documents(docs, "doc_id").collect()}
    monkeypatch.undo()
    for r in lm_score.score_documents(docs, "doc_id").collect():
        assert few[r.doc_id].base_score == pytest.approx(r.base_score) and few[r.doc_id].n_known == r.n_known


def test_language_model_learns_from_all_training_rows(spark):
    words = [f"w{k * 7 % 20}x" for k in range(20)]
    rng = random.Random(9)
    texts = [" ".join(words[(at + k) % 20] for k in range(60)) for at in (rng.randrange(20) for _ in range(8000))]
    docs = spark.createDataFrame(list(enumerate(texts)), EMPTY).repartition(3)
    got = lm_score.score_documents(docs, "doc_id", sample_docs=4).filter("n_tokens = 61").agg(F.avg("score"), F.avg("base_score")).first()
    assert got[0] > 0.8 * got[1]


def test_language_model_reads_the_written_numbers(spark, corpus):
    docs = spark.createDataFrame(list(enumerate(corpus)), EMPTY).coalesce(1)
    counts = lm_score.count_tokens(docs, 2, 7, "text", "doc_id")
    total, distinct = counts.agg(F.sum("n_train"), F.count_if(F.col("n_train") > 0)).first()
    scorer = lm_score.Scorer(counts.collect(), total, distinct)
    rows = lm_score.encoded(docs, "doc_id", "text", scorer).filter("ids IS NOT NULL")
    ids = {r.row_key: np.frombuffer(bytes(r.ids), lm_score.ID) for r in rows.collect()}
    assert all((ids[i] == scorer.network_ids(None if t is None else t.encode())).all() for i, t in enumerate(corpus))
    plain = lm_score.Scorer(counts.collect(), total, distinct).gru
    adam = lm_score.Adam(plain.p)
    for grad in plain.gradients(iter([ids[i] for i in range(len(corpus))]), 64):
        adam.update(plain.p, grad, 0.003)
    lm_score.average_pass(rows, "ids", scorer.gru, total)
    assert all(np.allclose(scorer.gru.p[k], plain.p[k], atol=1e-4) for k in plain.p)


def test_language_model_vocabulary_grows():
    from pyspark.sql import Row

    head = [Row(token=f"t{k}".encode(), n_train=10_000, n_all=10_000) for k in range(3000)]
    assert len(lm_score.Scorer(head, 30_000_000, 3000).gru.class_of) == 3002


def test_gru_gradients_and_probabilities():
    rng = np.random.default_rng(1)
    gru = lm_score.Gru(rng.integers(0, 50, 12).astype(float), hidden=5, classes=3)
    h = rng.normal(size=(1, 5)).astype(np.float32)
    p = [math.exp(float(gru.log_p(h, np.array([k]))[0])) for k in range(12)]
    assert sum(p) == pytest.approx(1, abs=1e-5)
    ids, lengths = rng.integers(0, 12, 37), np.array([5, 0, 20, 12])
    one = gru.log10_likelihood(ids, lengths[lengths > 0])
    alone = [gru.log10_likelihood(part, np.array([len(part)]))[0] for part in (ids[:5], ids[5:25], ids[25:])]
    assert one.tolist() == pytest.approx(alone, rel=1e-4)
    before = gru.log10_likelihood(ids, lengths[lengths > 0]).sum()
    gru.train(ids, lengths[lengths > 0], epochs=30)
    assert gru.log10_likelihood(ids, lengths[lengths > 0]).sum() > before


def test_language_id(spark):
    rng = random.Random(6)
    rows = [(i, text_in(lang, rng, rng.choice([5, 30, 300])), lang) for i, lang in enumerate(rng.choices(list(SYLLABLES), k=360))]
    rows += [(900, None, "en"), (901, "", "en"), (902, "12 34 !!", "de"), (903, text_in("de", rng, 40), None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit(1))
    model = langid.train_model(docs.filter("doc_id % 4 <> 0"), "doc_id", per_language=60)
    got = {r.doc_id: r for r in langid.identify(docs.drop("lang"), model).collect()}
    held = [r for r in rows if r[0] < 900 and r[0] % 4 == 0]
    assert sum(got[i].lang_pred == lang for i, _, lang in held) / len(held) > 0.95
    assert all((got[i].lang_pred, got[i].lang_score) == ("und", 0.0) for i in (900, 901, 902)) and got[903].lang_pred == "de"
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert langid.train_model(docs.filter("lang IS NULL"), "doc_id") is None and langid.identify(docs, None).filter("lang_pred <> 'und'").isEmpty()


def test_windows_cover_every_ngram():
    for n in (1, langid.WINDOW, langid.WINDOW + 1, 3 * langid.WINDOW + 7):
        data = bytes(random.Random(n).randrange(97, 123) for _ in range(n))
        w = [x.tobytes() for x in langid.windows_of(data)]
        assert all(any(data[k : k + 4] in x for x in w) for k in range(max(n - 3, 1)))


def test_folded_tables_equal_the_network():
    net = langid.ByteCNN(["a", "b"])
    x = np.random.default_rng(0).integers(0, 256, (3, 40)).astype(np.uint8)
    want = []
    for w, f in zip(langid.WIDTHS, net.filters, strict=True):
        e = net.emb[x]
        want.append(max_over(np.stack([sum(e[:, i + j] @ f[j] for j in range(w)) for i in range(40 - w + 1)], 1)))
    assert np.allclose(net.pooled(x, net.fold()), np.concatenate(want, 1) + net.bias, atol=1e-4)


def max_over(r):
    return r.max(1)


def test_toxicity(spark):
    rng = random.Random(7)
    bad = ["vilest", "scoundrel", "wretch", "lowei"]
    rows, labels = [], []
    for i in range(500):
        w = text_in("en", rng, rng.randrange(20, 120)).split()
        toxic = i % 5 == 0
        for _ in range(rng.randrange(2, 5) if toxic else 0):
            b = rng.choice(bad)
            w.insert(rng.randrange(len(w)), b + (text_in("de", rng, 1) if b == "lowei" else ""))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "?!"), (903, f"The {bad[0].upper()}, loweiquux!")]
    docs, marks = spark.createDataFrame(rows, EMPTY).withColumn("toxic", F.lit("clash")), spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    field = toxicity.learn(docs, marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(docs, field).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all((got[i].toxic_score >= toxicity.THRESHOLD) == bool(y) for i, y in held)
    assert all(got[i].toxic_score < 0.1 and got[i].toxic_spans == [] for i in (900, 901, 902))
    assert got[903].toxic_spans == [4, 10, 12, 21]
    nothing = toxicity.learn(docs, marks.limit(0))
    assert toxicity.score_toxicity(docs, nothing).agg(F.max("toxic_score")).first()[0] < 0.01


def test_marginals_equal_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    field = toxicity.ToxicField()
    field.transition = rng.normal(size=(2, 2))
    e = rng.normal(size=7)
    got = field.marginals(e, np.array([3, 4]), width=1)[0]
    for at, n in ((0, 3), (3, 4)):
        weights = {}
        for tags in itertools.product((0, 1), repeat=n):
            weights[tags] = math.exp(sum(e[at + i] for i in range(n) if tags[i]) + sum(field.transition[a, b] for a, b in itertools.pairwise(tags)))
        z = sum(weights.values())
        assert got[at : at + n].tolist() == pytest.approx([sum(w for t, w in weights.items() if t[i]) / z for i in range(n)])


@pytest.mark.parametrize("block", [8192, 100])
def test_nearest_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(700, 24)).astype(np.float32)
    x[50:400] = x[50]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(700, None), (720, [0.0] * 24), (740, [float("nan")] * 24), (760, [1.0, None] * 12), (780, [1.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("ids", F.lit(1))
    got = collections.defaultdict(dict)
    for r in ann.search(df, df.filter("vec_id % 20 = 0")).collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert sorted(got) == list(range(0, 700, 20))
    found = 0
    for q, near in got.items():
        score = (x.astype(np.float64) * x[q].astype(np.float64)).sum(1)
        order = [i for i in np.lexsort((np.arange(700), -np.round(score, 9))).tolist() if i != q][:20]
        assert sorted(near) == list(range(1, 21)) and all(s == pytest.approx(score[v]) for v, s in near.values())
        found += len({v for v, _ in near.values()} & set(order))
    assert found / (20 * len(got)) >= (0.9 if block < 8192 else 0.99)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def test_error_bounds_hold():
    rng = np.random.default_rng(9)
    x, q, p = rng.normal(size=(400, 64)), rng.normal(size=(20, 64)), ann.rotation(64)
    center = rng.normal(size=(1, 64))
    codes, length, agree = ann.encode(x, center, np.zeros(400, np.int64), p)
    guess, error = ann.estimate(codes, length, agree, q, p, center[0])
    assert (np.abs(guess - q @ x.T) <= error).mean() > 0.98


def test_boosted_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(int)
    model = boosting.BoostedTrees.train(x[:600], y[:600])
    assert ((model.probability(x[600:]) > 0.5) == y[600:]).mean() > 0.95
