"""The trained pair scorer: gradients, forward pass, learning on a planted graph, order and edge cases."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest

from litgraph.operators import ranking
from litgraph.operators.pair_scorer import Adam, PairScorer, ScorerSettings, SetNetwork, fit_pair_scorer, members, padded, training_groups, with_vectors


def random_sets(rng, n, dimensions):
    return [rng.normal(size=(rng.integers(1, 6), dimensions)).tolist() for _ in range(n)]


def plain_score(net, vectors):
    """One set, by loops over its members."""
    p = {k: v.tolist() for k, v in net.p.items()}
    times = lambda v, w, b=None: [sum(a * w[i][j] for i, a in enumerate(v)) + (b[j] if b else 0) for j in range(len(w[0]))]
    h = [[max(0, c) for c in times(v, p["w1"], p["b1"])] for v in vectors]
    q, k, v = ([times(m, p[w]) for m in h] for w in ("wq", "wk", "wv"))
    out = [0.0] * net.hidden
    for i in range(len(h)):
        e = [math.exp(sum(a * b for a, b in zip(q[i], kj, strict=True)) / net.hidden**0.5) for kj in k]
        z = [h[i][c] + sum(w * vj[c] for w, vj in zip(e, v, strict=True)) / sum(e) for c in range(net.hidden)]
        out = [o + max(0, g) / len(h) for o, g in zip(out, times(z, p["w2"], p["b2"]), strict=True)]
    return 1 / (1 + math.exp(-(sum(o * w for o, w in zip(out, p["w3"], strict=True)) + p["b3"][0])))


def test_forward_equals_plain_loops_and_ignores_order():
    rng, net = np.random.default_rng(1), SetNetwork(5, 4, seed=3)
    sets = random_sets(rng, 9, 5)
    got = net.scores(*padded(pa.array(sets)))
    assert got.tolist() == pytest.approx([plain_score(net, s) for s in sets])
    assert net.scores(*padded(pa.array([s[::-1] for s in sets]))).tolist() == pytest.approx(got.tolist())
    x, there = padded(pa.array([[], sets[0], None], pa.list_(pa.list_(pa.float64()))))
    assert there.sum(axis=1).tolist() == [0, len(sets[0]), 0] and net.scores(x, there)[1] == pytest.approx(got[0])


def test_gradients_equal_differences():
    rng, net = np.random.default_rng(2), SetNetwork(4, 5, seed=1)
    x, there = padded(pa.array(random_sets(rng, 7, 4)))
    net.p["b1"], net.p["b2"] = (0.1 * rng.normal(size=5) for _ in range(2))  # away from where no unit is active
    known, other = np.array([0, 0, 3, 3]), np.array([1, 2, 4, 5])
    loss, grad = net.margin_step(x, there, known, other, 0.7)
    assert loss > 0
    for name, g in grad.items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False).tolist():
            before, found = flat[i], []
            for step in (1e-6, -1e-6):
                flat[i] = before + step
                found.append(net.margin_step(x, there, known, other, 0.7)[0])
            flat[i] = before
            assert g.reshape(-1)[i] == pytest.approx((found[0] - found[1]) / 2e-6, abs=1e-5), name
    assert net.margin_step(x, there, known, other, -1.0)[0] == 0 and all((g == 0).all() for g in net.margin_step(x, there, known, other, -1.0)[1].values())


def test_weights_go_flat_and_back():
    net = SetNetwork(3, 4, seed=1)
    twin = SetNetwork(3, 4, seed=2).load(net.flat())
    assert all((twin.p[k] == v).all() for k, v in net.p.items())
    adam, p = Adam(0.5), {"w": np.array([1.0])}
    adam.step(p, {"w": np.array([2.0])})
    assert p["w"][0] == pytest.approx(0.5)


KINDS, TERMS, NEAR = 6, 240, 7


@pytest.fixture(scope="module")
def planted(spark):
    """Terms of six kinds, known pairs join kinds that belong together; predicates about a term resemble it. Of the known pairs a third is
    held out: neither trained on nor in the graph. Few neighbours are shared by chance."""
    rng, pick = np.random.default_rng(5), random.Random(5)
    centers = rng.normal(size=(KINDS, 10))
    vector = lambda k: [float(c) for c in centers[k] + 0.4 * rng.normal(size=10)]
    kind = {f"m:t{i}": i % KINDS for i in range(TERMS)}
    vectors, edges = [(t, vector(k)) for t, k in kind.items()], []
    for t, k in kind.items():
        for j in range(NEAR):
            vectors.append((f"p:{t[2:]}:v:{j}", vector(k)))
            edges.append((t, f"p:{t[2:]}:v:{j}"))
            if pick.random() < 0.3:
                edges.append((pick.choice(list(kind)), f"p:{t[2:]}:v:{j}"))
    belongs = lambda a, b: kind[a] ^ 1 == kind[b]
    pairs = [(a, b) for a in kind for b in kind if belongs(a, b)]
    pick.shuffle(pairs)
    known, held = pairs[:600], pairs[600:900]
    strangers = [(a, b) for a, b in ((pick.choice(list(kind)), pick.choice(list(kind))) for _ in range(500)) if not belongs(a, b)][:300]
    both = [(s, d) for s, d in edges] + [(d, s) for s, d in edges]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(3).cache()
    asked = [(i, *p, int(i < len(held))) for i, p in enumerate(held + strangers)]
    return frame(known, "subj string, obj string"), frame(both, "src string, dst string"), frame(vectors, "name string, embedding array<double>"), frame(asked, "ord long, subj string, obj string, label int")


SETTINGS = ScorerSettings(neighbours=5, swaps=3, scrambles=2, rounds=6, hidden=16, parts=3)


@pytest.fixture(scope="module")
def groups(planted):
    known, edges, vectors, _ = planted
    return training_groups(known, edges, vectors, SETTINGS).cache()


def test_groups_hold_the_pair_and_its_negatives(planted, groups):
    known, edges, vectors, _ = planted
    of, near = {r.name: list(r.embedding) for r in vectors.collect()}, {}
    for r in edges.collect():
        near.setdefault(r.src, set()).add(r.dst)
    rows = groups.collect()
    assert {(r.subj, r.obj) for r in rows} == {(r.subj, r.obj) for r in known.collect()}
    for r in rows[:60]:
        own = r.sets[0]
        assert own[:2] == [of[r.subj], of[r.obj]] and len(own) <= 2 + 2 * SETTINGS.neighbours
        only = {n for n in near[r.subj] ^ near[r.obj] if n.startswith("p:")}
        assert all(v in [of[n] for n in only] for v in own[2:])
        assert 1 + SETTINGS.scrambles <= len(r.sets) <= 1 + SETTINGS.swaps + SETTINGS.scrambles
        for s in r.sets[-SETTINGS.scrambles :]:
            assert s[:2] == own[:2] and len(s) == 2 + 2 * SETTINGS.neighbours


def test_it_ranks_held_out_pairs_better_than_shared_neighbours(planted, groups):
    known, edges, vectors, asked = planted
    scorer = fit_pair_scorer(groups, SETTINGS)
    assert len(scorer.losses) == SETTINGS.rounds and scorer.losses[-1] < 0.5 * scorer.losses[0]
    scored = scorer.rank_pairs(asked, edges, vectors)
    auc = lambda df: ranking.roc_auc(df, "score", "label").first().auc
    plain = asked.join(ranking.predict_pairs(asked.select("ord", "subj", "obj"), edges, "predicate").select("ord", "score"), "ord")
    assert auc(scored) > 0.85 > 0.7 > auc(plain)
    again = fit_pair_scorer(groups.repartition(7), SETTINGS)
    assert (again.network.flat() == scorer.network.flat()).all()


def test_scores_are_the_networks_and_in_the_order_asked(planted):
    _, edges, vectors, asked = planted
    scorer = PairScorer(SetNetwork(10, 4, seed=8), SETTINGS)
    more = asked.limit(40).unionByName(asked.sparkSession.createDataFrame([(10**6, "m:t1", "m:nobody", 0), (-1, "m:nobody", "m:none", 0), (10**6 + 1, "m:t3", "m:t3", 1), (10**6 + 1, "m:t3", "m:t3", 1)], asked.schema))
    got = scorer.rank_pairs(more.repartition(5), edges, vectors).collect()
    assert [r.ord for r in got] == sorted(r.ord for r in more.collect()) and [r.score for r in got if "no" in r.obj] == [0.0, 0.0]
    sets = {(r.subj, r.obj): r.vectors for r in with_vectors(members(more, edges, SETTINGS), vectors, "subj", "obj").collect()}
    for r in got:
        if "no" not in r.obj:
            assert r.score == pytest.approx(plain_score(scorer.network, sets[r.subj, r.obj]))


def test_a_pairs_own_terms_are_no_neighbours(spark):
    pairs = spark.createDataFrame([("a", "b")], "subj string, obj string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c"), ("b", "d"), ("b", "e"), ("a", "e")], "src string, dst string")
    got = {r.place: r.name for r in members(pairs, edges, ScorerSettings(neighbours=3, kind=None)).collect()}
    assert got == {0: "a", 1: "b", 2: "c", 5: "d"}


def test_nothing_to_learn_from(spark, planted):
    _, edges, vectors, _ = planted
    none = spark.createDataFrame([("m:x", "m:y")], "subj string, obj string")
    with pytest.raises(ValueError):
        fit_pair_scorer(training_groups(none, edges, vectors, SETTINGS), SETTINGS)


def test_edges_are_read_once_around_the_terms(spark, planted):
    """edges that can be expensive to make are read for the neighbourhoods and for the nodes that scrambles draw from, no more often."""
    known, edges, vectors, asked = planted
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted, n = edges.select("src", "dst").mapInArrow(count, "src string, dst string"), edges.count()
    groups = training_groups(known, counted, vectors, SETTINGS)
    assert groups.count() and seen.value <= 2 * n
    before = seen.value
    assert PairScorer(SetNetwork(10, 4, seed=8), SETTINGS).rank_pairs(asked, counted, vectors).count() == asked.count()
    assert seen.value - before <= n
