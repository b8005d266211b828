"""Operators with an exact contract, against brute force."""

import random
import zlib

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from litgraph.llm import decontaminate, jaccard_join, packing, pii, suffix_dedup, warc

EMPTY = "doc_id long, text string"


def test_decontamination(spark, documents, corpus):
    long = corpus[6].split()
    items = [(1, " ".join(long[5:40])), (2, "a"), (3, None), (4, ""), (5, "A, b"), (6, " ".join(long[30:36])), (6, " ".join(long[30:36])), (7, "be be be be be be be be be be be")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.decontaminated(corpus, items)
    for block in (decontaminate.BLOCK_WORDS, 20):
        got = {r.doc_id: r for r in decontaminate.match_benchmark(documents, bench, block_words=block).collect()}
        for i, (n, hit, ids) in enumerate(want):
            spans = got[i].hit_spans
            assert (got[i].n_words, sum(spans[1::2]) - sum(spans[::2]), set(got[i].hit_items)) == (n, len(hit), ids)
            assert {p for s, e in zip(spans[::2], spans[1::2], strict=True) for p in range(s, e)} == hit
    cut = {r.doc_id: r.text for r in decontaminate.cut_spans(decontaminate.match_benchmark(documents, bench), max_coverage=1.1).collect()}
    assert len(cut) == len(corpus) and cut[0] is None
    for i, (n, hit, _) in enumerate(want):
        assert len(brute.words(cut[i])) <= n - len(hit) if hit else cut[i] == corpus[i]
    assert decontaminate.match_benchmark(documents, bench.limit(0)).filter("size(hit_items) > 0").isEmpty()
    assert decontaminate.match_benchmark(spark.createDataFrame([], EMPTY), bench).count() == 0


def test_decontamination_without_item_id(spark, tmp_path):
    import hashlib

    spark.createDataFrame([(1, "x a b c y"), (2, "z")], EMPTY).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, "a b c"), (None, "b c"), (3, "c")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.op1_decontaminate(spark, f"file://{tmp_path}").collect()}
    assert got == {1: (5, 3, 2, hashlib.sha256(b"3").hexdigest(), True), 2: (1, 0, 0, hashlib.sha256(b"").hexdigest(), False)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=9), max_size=5), st.lists(st.sampled_from("abcd"), max_size=40))
def test_automaton_finds_every_window(items, text):
    matcher = decontaminate.Matcher([(i, [w.encode() for w in x]) for i, x in enumerate(items)], 4)
    spans, ids = matcher.spans([w.encode() for w in text])
    _, hit, want = brute.decontaminated([" ".join(text)], [(i, " ".join(x)) for i, x in enumerate(items)], 4)[0]
    assert {p for s, e in zip(spans[::2], spans[1::2], strict=True) for p in range(s, e)} == hit and ids == want


@pytest.mark.parametrize(("size", "num", "den", "block"), [(3, 90, 100, jaccard_join.BLOCK), (3, 90, 100, 3), (5, 4, 5, 3)])
def test_jaccard_components(documents, corpus, monkeypatch, size, num, den, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.link_documents(documents, words=size, num=num, den=den).collect()}
    assert got == brute.components(dict(enumerate(corpus)), size, num, den)


def test_jaccard_edges(spark):
    assert jaccard_join.link_documents(spark.createDataFrame([], EMPTY)).count() == 0
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (9, "A B C D"), (7, None)]
    got = sorted(map(tuple, jaccard_join.link_documents(spark.createDataFrame(rows, EMPTY)).collect()), key=str)
    assert got == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (9, 2, 5), (7, 0, 7)], key=str)


def test_jaccard_null_id_before_its_copy(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(None, text), (7, text), (8, text.replace("w79", "other"))]
    got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(spark.createDataFrame(rows, EMPTY).coalesce(1)).collect()}
    assert got == {None: None, 7: 7, 8: 7}


def test_jaccard_second_text_of_an_id(spark):
    one, two = (" ".join(f"{c}{k}" for k in range(80)) for c in "vw")
    for first, second in ((one, two), (two, one)):
        rows = [(5, first), (5, second), (8, two.replace("w79", "other")), (9, one.replace("v79", "other"))]
        got = {r.doc_id: r.component_id for r in jaccard_join.link_documents(spark.createDataFrame(rows, EMPTY).coalesce(1)).collect()}
        assert got == {5: 5, 8: 5, 9: 5}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sets(st.integers(0, 14), min_size=1), st.integers(0, 3)), min_size=1, max_size=30), st.sampled_from([(1, 2), (4, 5)]))
def test_links_in_block(rows, threshold):
    import numpy as np

    num, den = threshold
    sets, component = [np.array(sorted(s), np.uint64) for s, _ in rows], np.array([c for _, c in rows])
    got = jaccard_join.links_in_block(sets, component, num, den)

    def joined(pairs):
        root = {c: c for c in set(component.tolist())}
        for i, j in pairs:
            a, b = root[component[i]], root[component[j]]
            root = {k: a if v == b else v for k, v in root.items()}
        return {frozenset(k for k in root if root[k] == v) for v in root.values()}

    linked = [(i, j) for i in range(len(rows)) for j in range(i) if den * len(rows[i][0] & rows[j][0]) >= num * len(rows[i][0] | rows[j][0])]
    assert joined(got) == joined(linked) and set(map(tuple, map(sorted, got))) <= {(j, i) for i, j in linked}


def test_signatures_meet_whenever_sets_link():
    import numpy as np

    rng = random.Random(1)
    for num, den, boundary in ((90, 100, 19), (4, 5, 5), (90, 100, 9)):
        own = jaccard_join.Signatures(num, den, boundary)
        for _ in range(150):
            n = rng.choice([3, 9, 10, 12, 19, 20, 25, 60, 200])
            a = np.unique(np.array([rng.getrandbits(63) for _ in range(n)], np.uint64))
            drop = rng.randrange(0, n // 5 + 1)
            b = np.unique(np.concatenate([a[drop:], np.array([rng.getrandbits(63) for _ in range(rng.randrange(0, n // 5 + 1))], np.uint64)]))
            both = len(np.intersect1d(a, b))
            if both and den * both >= num * (len(a) + len(b) - both):
                assert len(np.intersect1d(own(a), own(b)))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 1])
def test_suffix_removal(documents, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.remove_repeats(documents).collect()}
    assert [got[i] for i in range(len(corpus))] == brute.without_repeats(corpus)


def test_suffix_edges(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], EMPTY)).count() == 0
    one = "y" + "".join(chr(97 + i * i % 23) + str(i) for i in range(200))
    got = sorted(tuple(r)[:4] for r in suffix_dedup.remove_repeats(spark.createDataFrame([(3, one), (3, one), (4, "z" + one)], EMPTY)).collect())
    n = len(one)
    assert got == [(3, n, n, 1), (3, n, n, 1), (4, n + 1, n, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=4))
def test_bucket_refinement(strings):
    data = [s.encode() for s in strings]
    width = 12
    all_places = [(i, k, d[k : k + width]) for i, d in enumerate(data) for k in range(len(d) - width + 1)]
    found = suffix_dedup.refined_repeats(data, width)
    for i, k, s in all_places:
        assert (k in found[i].tolist()) == (sum(x[2] == s for x in all_places) > 1)


PERSONAL = st.lists(st.sampled_from(["a@b.co", "x.y+z@m-1.example.com", "@", "1.2.3.4", "300.1.1.1", "01.002.3.4.5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (212) 555-0100", "+", "1", " ", ".", "-", "é", "a@", "@b.c", "99", "+44 20 7946 0958."]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(PERSONAL)
def test_personal_base_spans(parts):
    assert pii.base_spans("".join(parts)) == brute.personal("".join(parts))


def test_personal_digits_take_linear_time():
    assert pii.base_spans("1" * 300_000) == [] and pii.base_spans("1." * 100_000 + "a@" * 50_000)


def test_personal_spans(spark):
    rng = random.Random(3)
    names = ["ann", "bob", "eve"]
    texts = [f"text {k} of {rng.choice(names)}.{k}@mail{k % 9}.example.com and 10.0.{k % 256}.7 then 4111111111111111 call +1 (212) 555-{1000 + k} version 2.0.{k}" for k in range(300)]
    docs = spark.createDataFrame([*enumerate(texts), (900, None), (901, ""), (902, "nothing here"), (903, "mail ann(at)mail.com or 212-555-0187")], EMPTY)
    found = pii.find_spans(docs, pii.train_detector(docs, "doc_id"))
    rows = {r.doc_id: r for r in pii.digest_columns(found).collect()}
    assert (rows[5].n_email, rows[5].n_ip, rows[5].n_card, rows[5].n_phone) == (1, 1, 1, 1)
    assert rows[900].spans == rows[901].spans == rows[902].spans == ""
    clean = {r.doc_id: r.text for r in pii.redact(found).collect()}
    assert clean[900] is None and clean[902] == "nothing here" and "@" not in clean[5] and "[EMAIL]" in clean[5] and "version 2.0.5" in clean[5]
    assert pii.digest_columns(pii.find_spans(docs.limit(0), pii.Detector(None, [2.0] * 4))).count() == 0


def test_packing(spark, documents, corpus):
    import numpy as np
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    tok = Tokenizer.from_file(path)
    pieces = packing.pack(documents, path, window=256, shard_docs=40).collect()
    for i, t in enumerate(corpus):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for p in sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start):
            assert (p.start, p.doc_tokens, p.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + p.length].tobytes()))
            at += p.length
        assert at == len(ids)
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    short = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at and length > 0
            at += length
        assert at <= 256
        short += at < 256
    assert short <= len(corpus) // 40 + 2
    assert packing.pack(spark.createDataFrame([], EMPTY), path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["It's", "can't", "WE'LL", "'S", "a1b22", "naïve", "ÉCOLE", "straße", "µm", "ª", "×", "x×y", "İ", "ΟΔΟΣ", "e\u0301", "\u0301", "<|endoftext|>", "<|", "...", "--a", "\u00a0", "\x1c", "漢字", "٣", " ", "\n", "q", "\x7f", "\x01"]), max_size=10))
def test_pieces_of_words_keep_the_ids(parts):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    definition = open(path, encoding="utf-8").read()
    if "own" not in _TOKENIZERS:
        _TOKENIZERS.update(own=packing.WordTokenizer(definition, True, 1), whole=Tokenizer.from_str(definition))
    text = "".join(parts)
    assert _TOKENIZERS["own"].plain
    assert _TOKENIZERS["own"]([text.encode()])[0].tolist() == [*_TOKENIZERS["whole"].encode(text, add_special_tokens=False).ids, 1]


_TOKENIZERS: dict = {}


def test_retrieval_prefers_shared_rare_terms():
    import numpy as np

    docs = [np.array([1, 2, 900]), np.array([1, 2, 3]), np.array([5, 900, 6]), *[np.array([1, 2, 7 + k]) for k in range(9)]]
    assert packing.Bm25Index(docs).search(docs[0])[:2].tolist() == [0, 2]


def test_retrieval_ignores_terms_of_the_seed_alone():
    import numpy as np

    docs = [np.array([1, 2, 900, *range(2000, 2060)]), np.array([1, 2, 3]), np.array([5, 900, 6]), *[np.array([1, 2, 7 + k]) for k in range(9)]]
    assert [d for d in packing.Bm25Index(docs).search(docs[0]).tolist() if d][:1] == [2]
    assert packing.Bm25Index([np.array([3, 4]), np.array([5])]).search(np.array([3])).tolist() == []


def test_packing_deals_related_tails_to_one_shard(spark):
    rng = random.Random(8)
    groups = [[f"{a}{b}{a}" for a in rng.sample("bcdfghjklmnpqrstvwxz", 5) for b in "aeiou"] for _ in range(12)]
    texts = [" ".join(rng.choice(groups[i % 12] if rng.random() < 0.6 else ["the", "of", "and", "to"]) for _ in range(40)) for i in range(960)]
    docs = spark.createDataFrame(list(enumerate(texts)), EMPTY).repartition(3)
    shards = {}
    for p in packing.pack(docs, packing.default_tokenizer(), window=256, shard_docs=80).collect():
        shards.setdefault(p.sequence_id >> 32, set()).add(p.doc_id)
    assert len(shards) > 6 and sum(map(len, shards.values())) == 960 and max(map(len, shards.values())) < 240
    # Of a document's shard, the part of its own group: a twelfth, if words didn't matter.
    same = [sum(i % 12 == j % 12 for j in s) / len(s) for s in shards.values() for i in s]
    assert sum(same) / len(same) > 0.4


def test_warc_round_trip(spark):
    rng = random.Random(2)
    html = [f"<html><body><p>{' '.join(rng.choice(['some', 'page', 'text']) for _ in range(80))}</p></body></html>" for _ in range(40)]
    rows = [(i, f"http://a/{i}\r\nX: y", h, "extra") for i, h in enumerate([*html, html[3], html[3], None, "", "é"])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(2)
    manifest = warc.write_archives(pages)
    back = {r.page_id: r for r in warc.read_archives(manifest).collect()}
    assert len(back) == len(rows) and (back[40].record_type, back[40].refers_to, back[41].refers_to) == ("revisit", 3, 3) and (back[43].record_type, back[43].refers_to) == ("revisit", 42)
    for i, _, h, _ in rows:
        assert back[i].payload_bytes == len((h or "").encode())
        if back[i].record_type == "response":
            assert bytes(back[i].payload) == (h or "").encode()
    assert all(r.record_type == "response" for r in warc.read_archives(warc.write_archives(pages, min_bytes=10**6)).collect())
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_dictionary_is_embedded_and_used():
    records = [warc.record(i, "http://a/", f"<html><head><title>number {i}</title></head><body>{'the same boilerplate ' * 8}{i * 7919}</body></html>".encode(), "D" * 32) for i in range(200)]
    data = warc.archive_bytes_of(records)
    assert list(warc.read_archive(data)) == records and data[:4] == bytes.fromhex("5d2a4d18") and data[8:12] == bytes.fromhex("37a430ec")
    with pytest.raises(ValueError):
        list(warc.read_archive(data[8:]))


def test_padding_report(spark):
    df = spark.createDataFrame([(1, 2048), (2, 1024), (3, 1000)], "sequence_id long, length long")
    assert tuple(packing.padding(df).first()) == (3, 4072, 1048)
    assert df.agg(F.sum("length")).first()[0] == 4072
