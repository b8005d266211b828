"""Vector codes, fingerprints and the filter audit against plain loops, with their edge cases."""

import collections
import hashlib
import random

import brute
import numpy as np
import pytest

from litgraph.llm import fingerprints, vector_codes
from litgraph.llm.filter_audit import audit, flag_documents
from litgraph.llm.fingerprints import Fingerprinter, edited, fingerprint_documents
from litgraph.llm.vector_codes import compress, nearest

VECTORS = "vec_id long, embedding array<float>, label int, part int, error string"


def vector_rows(n, width, seed=1, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.integers(-2, 3, (n, width)) / grid if grid else rng.normal(size=(n, width)) / 3
    return [(int(i), [float(np.float32(c)) for c in v], int(i) % 3 if i % 5 else None, 0, "x") for i, v in zip(rng.permutation(n), x, strict=True)]


def check_codes(spark, rows, usable, **settings):
    got = compress(spark.createDataFrame(rows, VECTORS).repartition(5), **settings).collect()
    usable = sorted(usable, key=lambda r: (r[0] is None, r[0], r[1]))
    found, books = brute.vector_codes([r[:3] for r in usable], **settings)
    label = collections.Counter()
    for r, (_, e) in zip(usable, found, strict=True):
        label[r[2]] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(((r[0], code, e, label[r[2]], digest) for r, (code, e) in zip(usable, found, strict=True)), key=key)


def test_vector_codes_equal_plain_loops(spark):
    rows = vector_rows(150, 24)
    check_codes(spark, rows, rows)


def test_vector_codes_with_ties_and_repeats(spark):
    rows = vector_rows(90, 16, 2, grid=4096)
    rows += rows[:20] + [(None, rows[3][1], 1, 0, "x"), (None, rows[4][1], 1, 0, "x")]
    check_codes(spark, rows, rows)


def test_vectors_that_take_no_part(spark):
    rows = vector_rows(40, 16, 3)
    bad = [None, [], [None] + [0.5] * 15, [float("nan")] + [0.5] * 15, [float("inf")] + [0.5] * 15, [0.5] * 7, [40000.0] + [0.0] * 15]
    check_codes(spark, rows + [(1000 + i, v, 1, 0, "x") for i, v in enumerate(bad)], rows)


@pytest.mark.parametrize("n, width", [(5, 16), (30, 20), (30, 3), (1, 8)])
def test_few_vectors_and_odd_lengths(spark, n, width):
    rows = vector_rows(n, width, 4)
    check_codes(spark, rows, rows)


def test_other_settings_and_many_labels(spark, monkeypatch):
    rows = vector_rows(70, 12, 5)
    check_codes(spark, rows, rows, parts=3, entries=5, rounds=2, scale=100)
    monkeypatch.setattr(vector_codes, "SMALL", 1)
    check_codes(spark, rows, rows, parts=4, entries=7, rounds=1, scale=64)


def test_no_vectors(spark):
    got = compress(spark.createDataFrame([(1, None, 1, 0, "x")], VECTORS))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"] and got.count() == 0
    with pytest.raises(ValueError):
        compress(spark.createDataFrame([], VECTORS), entries=300)


def test_partial_distances_save_work_and_lose_nothing():
    rng = np.random.default_rng(6)
    entries = np.floor(rng.normal(size=(16, 8)) * 4096 * np.linspace(0.1, 2, 8)).astype(np.int64)
    x = np.floor(rng.normal(size=(8, 4000)) * 4096 * np.linspace(0.1, 2, 8)[:, None]).astype(np.int64)
    index, best, work = nearest(x, entries)
    whole = ((x.T[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (index == whole.argmin(axis=1)).all() and (best == whole.min(axis=1)).all() and work < whole.size * 8 * 0.7
    twice = np.concatenate([entries, entries])
    assert (nearest(x, twice)[0] == index).all()


def plain_prints(docs):
    """(id, text, following text) in the contract's order."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    return [(i, t or "", order[(k + 1) % len(order)][1] or "") for k, (i, t) in enumerate(order)]


def check_prints(spark, docs, parts=4):
    got = {r.doc_id: r for r in fingerprint_documents(spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, tie string, range int").repartition(parts)).collect()}
    make = Fingerprinter()
    assert len(got) == len(docs)
    for i, text, following in plain_prints(docs):
        new, r = edited(text, following), got[i]
        n = len(text) // 3
        assert new == text[: len(text) - n] + following[:n] and r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        own, other, after = (make(t.encode()) for t in (text, new, following))
        assert (r.fingerprint, r.edited_fingerprint) == (own.hex(), other.hex())
        assert (r.near_edited, r.near_next) == (make.likeness(own, other), make.likeness(own, after))


def test_fingerprints_of_the_corpus(spark, corpus):
    check_prints(spark, [(7 * i - 90, t) for i, t in enumerate(corpus)])


@pytest.mark.parametrize("texts", [["a lone text of some words here"], [None, ""], ["x", None, "é ü", "a b c d e f g h", ""]])
def test_fingerprints_of_few_documents(spark, texts):
    check_prints(spark, list(enumerate(texts)), 2)


def test_fingerprints_with_many_ranges(spark, corpus):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        check_prints(spark, list(enumerate(corpus)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_fingerprints_of_repeated_and_null_ids(spark):
    docs = [(1, "one two three"), (1, "one two three"), (1, "four five six"), (None, "seven"), (None, None), (3, "a b c d e f g")]
    got = fingerprint_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert collections.Counter(r.doc_id for r in got) == {1: 3, None: 2, 3: 1} and all(r.edited_sha256 and 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert fingerprint_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_likeness_follows_the_jaccard_similarity():
    rng, make, off = random.Random(8), Fingerprinter(), []
    for k in range(120):
        n = rng.choice([60, 200, 800, 3000])
        w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        same = rng.random()
        a, b = " ".join(w), " ".join(w[: int(n * same)] + [f"v{rng.randrange(10**6)}" for _ in range(n - int(n * same))])
        sa, sb = brute.shingles(a), brute.shingles(b)
        off.append(make.likeness(make(a.encode()), make(b.encode())) - len(sa & sb) / len(sa | sb))
    assert abs(np.mean(off)) < 0.015 and np.abs(off).max() < 0.2 and np.sqrt(np.mean(np.square(off))) < 0.05


def test_very_long_text_has_one_fingerprint_whatever_its_parts(monkeypatch):
    rng = random.Random(9)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(400_000)).encode()
    whole = Fingerprinter()(text)
    parts = fingerprints.token_lists.__globals__["text_parts"]
    monkeypatch.setattr(fingerprints, "token_lists", lambda d: (p.lower().split() for p in parts(d, 50_000)))
    assert Fingerprinter()(text) == whole
    monkeypatch.setattr(fingerprints, "token_lists", lambda d: ([w] for w in d.lower().split()))
    assert Fingerprinter()(text[:3000]) == Fingerprinter()(text[:3000] + b" ")


def test_densified_bins_come_from_full_ones():
    make = Fingerprinter(bins=64)
    least, empty = np.arange(64, dtype=np.uint64), np.ones(64, bool)
    empty[[5, 40]] = False
    out = make.densified(least, empty)
    assert set(out.tolist()) == {5, 40} and out[5] == 5 and out[40] == 40
    with pytest.raises(ValueError):
        Fingerprinter(bins=100)


def check_audit(spark, docs, labels):
    got = audit(flag_documents(spark.createDataFrame([(*d, 1, True, 2.0) for d in docs], "doc_id long, text string, lang string, n int, A boolean, part double").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    marks = {}
    for i, q, t in labels:
        old = marks.get(i, (0, 0))
        marks[i] = (int(q == 1 or old[0] == 1), int(t == 1 or old[1] == 1))
    want = brute.audited(docs, {k: v for k, v in marks.items() if k is not None})
    rows = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got.collect()}
    assert rows == want and len(rows) == 600 * len({d[2] or "" for d in docs})


def test_audit_equals_every_order_gone_through(spark):
    rng = random.Random(10)
    docs = []
    for i in range(260):
        n = rng.choice([5, 150, 199, 200, 201, 320])
        w = [f"w{rng.randrange(rng.choice([40, 2000]))}" for _ in range(n)]
        if rng.random() < 0.3:
            w = [x.upper() + "ABC" for x in w]
        if rng.random() < 0.3:
            w[rng.randrange(n)] = rng.choice("#$%&*|")
        docs.append((i, rng.choice([" ", "\n", "\x0b\t "]).join(w), rng.choice(["en", "de", None, ""])))
    docs += [(1000 + i, docs[i % 9][1], rng.choice(["en", "de"])) for i in range(60)]
    docs += [(2000, None, "en"), (2001, "", "de"), (2002, " \t", "en"), (None, docs[0][1], "en"), (None, None, None), (5, docs[5][1], "en"), (3000, "Ünï ß " * 90, "xx"), (3001, "w " * 200_000, "xx")]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 260, 2)] + [(2, 1, 0), (4, None, 1), (None, 1, 1), (10**6, 1, 1), (2000, 1, None)]
    check_audit(spark, docs, labels)


def test_audit_at_the_limits(spark):
    distinct = [f"w{k}" for k in range(200)]
    docs = [(1, " ".join(distinct), "a"), (2, " ".join(distinct[:100] * 2), "a"), (3, " ".join(distinct[:99] * 2 + ["w0", "w1"]), "a"), (4, "AAA" + "x" * 97, "a"), (5, "AAAA" + "x" * 96, "a"), (6, " ".join(distinct), "b")]
    check_audit(spark, docs, [])


def test_audit_of_nothing(spark):
    flags = flag_documents(spark.createDataFrame([], "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert audit(flags).count() == 0
    with pytest.raises(ValueError):
        audit(flags, "AA")


def test_audit_of_three_filters(spark):
    flags = spark.createDataFrame([("p", True, False, False, True, False), ("p", True, True, False, False, True), ("p", False, False, True, False, False)], "part string, X boolean, Y boolean, Z boolean, good boolean, toxic boolean")
    got = {(r.filter_order, r.step): r for r in audit(flags, "XYZ").collect()}
    assert len(got) == 18 and got["XYZ", 1][3:] == (1, 2, 0, 1, 1, 1, 9)
    assert got["YXZ", 2].removed == 1 and got["YXZ", 2].redundant == 1 and got["ZYX", 3].kept == 0
