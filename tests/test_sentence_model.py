"""The learnt sentence boundaries: statistics against plain loops, and what the model makes of texts."""

import collections
import math
import random
import re

import pytest

from litgraph.operators import sentence_model as M
from litgraph.operators.sentence_model import SentenceModel, explode_trained, train_sentence_model


@pytest.fixture(scope="module")
def texts():
    """Prose with abbreviations before capitals and small letters, initials, numbers, quotes and dots."""
    rng = random.Random(2)
    nouns = "cell lung heart patient tumour valve artery doctor smoke pulse muscle nerve".split()
    names = "Smith Brown Miller Keller".split()
    out = []
    for _ in range(300):
        say = []
        for _ in range(rng.randrange(3, 9)):
            w = [rng.choice(nouns) for _ in range(rng.randrange(4, 9))]
            k = rng.random()
            if k < 0.2:
                w[1:1] = [rng.choice(["Dr.", "Prof."]), rng.choice(names)]
            elif k < 0.4:
                w[2:2] = [rng.choice(["approx.", "e.g.", "cf."]), rng.choice(nouns)]
            elif k < 0.5:
                w[1:1] = [f"{rng.choice('JKM')}.", rng.choice(names)]
            elif k < 0.6:
                w[2:2] = [f"{rng.randrange(100)}.{rng.randrange(10)}", "mg"]
            say.append(f"{rng.choice(['The', 'However', 'This'])} {' '.join(w)}{rng.choice(['.', '.', '.', '?', '!'])}")
        out.append(" ".join(say))
    return [*out, "", None, "   ", 'He said "tumour." Then (it valve.) Well... "Yes!" she said.', "one"]


@pytest.fixture(scope="module")
def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).cache()


def plain(texts):
    """(token, core, type, stop, the one before) for each token."""
    out = []
    for t in texts:
        before = None
        for token in (t or "").split():
            core, kind = SentenceModel.type_of(token)
            here = (token, core, kind, core.endswith("."))
            out.append((*here, before))
            before = here
    return out


def plain_abbreviations(counts):
    n, stops = sum(map(sum, counts.values())), sum(w for w, _ in counts.values())
    out = {}
    for kind, (w, wo) in counts.items():
        if w and kind != M.NUMBER and re.search(r"[^\W\d_]", kind):
            inner = kind.count(".")
            size = max(len(kind) - inner, 1)
            ll = -2 * (w * math.log(stops / n) + wo * math.log(1 - stops / n) - w * math.log(0.99) - wo * math.log(0.01))
            score = ll * math.exp(-size) * (inner + 1) * size**-wo
            if score >= M.ABBREVIATION:
                out[kind] = score
    return out


def ratio(a, b, k, n):
    part = lambda x, m, p: x * math.log(p) + (m - x) * math.log(1 - p) if 0 < p < 1 else 0
    return -2 * (part(k, a, b / n) + part(b - k, n - a, b / n) - part(k, a, k / a) - part(b - k, n - a, (b - k) / (n - a)))


def test_statistics_equal_plain_loops(frame, texts):
    rows = plain(texts)
    counts = collections.defaultdict(lambda: [0, 0])
    for _, _, kind, stop, _ in rows:
        counts[kind][not stop] += 1
    pairs = M.neighbour_counts(frame, "text").cache()
    got = M.type_counts(pairs).cache()
    assert {r.type: [r.with_stop, r.without] for r in got.collect()} == counts
    short = M.abbreviations(got).cache()
    want = plain_abbreviations(counts)
    assert {r.type: r.score for r in short.collect()} == pytest.approx(want)
    assert {"dr", "prof", "approx", "e.g", "cf"} <= set(want) and not {"cell", "lung", "valve"} & set(want)

    places = M.marked(pairs, short).cache()
    after, seen, whole = collections.Counter(), collections.defaultdict(set), collections.Counter()
    breaks = 0
    for token, core, kind, _, before in rows:
        place = "b" if before is None else "m"
        if before and before[3]:
            place = "?" if before[2] in want or not before[2].strip(".") else "b"
        elif before and re.search(r"[!?][\"'“”‘’«»)\]}]*$", before[0]):
            place = "b"
        whole[kind] += 1
        if before and place == "b":
            breaks += 1
            if not (before[3] and (before[2] == M.NUMBER or (len(before[2]) == 1 and before[2].isalpha()))):
                after[kind] += 1
        seen[kind] |= {("lower", core[:1].islower()), ("upper", core[:1].isupper()), ("upper_inside", core[:1].isupper() and place == "m"), ("lower_first", core[:1].islower() and place == "b")}
    for r in M.contexts(places).collect():
        assert r.n == whole[r.type] and all(r[c] == ((c, True) in seen[r.type]) for c in ("lower", "upper", "upper_inside", "lower_first"))
    n = len(rows)
    starts = {k: ratio(breaks, whole[k], x, n) for k, x in after.items() if k.isalpha() and n / breaks > whole[k] / x}
    assert {r.type: r.score for r in M.sentence_starters(places).collect()} == pytest.approx({k: v for k, v in starts.items() if v >= M.STARTER})
    assert {"the", "however", "this"} <= {k for k, v in starts.items() if v >= M.STARTER}

    both = collections.Counter((b[2], kind) for _, _, kind, _, b in rows if b and b[3] and (b[2] == M.NUMBER or (len(b[2]) == 1 and b[2].isalpha())) and re.search(r"[^\W_]", kind))
    tied = {p: ratio(whole[p[0]], whole[p[1]], k, n) for p, k in both.items() if k > 1 and n / whole[p[0]] > whole[p[1]] / k}
    assert {(r.before_type, r.type): r.score for r in M.collocations(places, got).collect()} == pytest.approx({p: v for p, v in tied.items() if v >= M.COLLOCATION})


@pytest.fixture(scope="module")
def model(frame):
    return train_sentence_model(frame)


def test_abbreviations_initials_and_numbers_end_no_sentence(model):
    say = "The doctor Dr. Smith saw approx. valve and e.g. heart. However J. Brown said 3.5 mg is no cell! This lung. The pulse? The nerve."
    assert model.split(say) == ["The doctor Dr. Smith saw approx. valve and e.g. heart.", "However J. Brown said 3.5 mg is no cell!", "This lung.", "The pulse?", "The nerve."]
    assert model.split("The cell, cf. The heart.") == ["The cell, cf.", "The heart."]  # a sentence starter after an abbreviation
    assert model.split('He said "tumour." Then (it valve.) The cell.') == ['He said "tumour."', "Then (it valve.)", "The cell."]
    assert model.split(None) == [] and model.split("") == [] and model.split(" \n ") == [] and model.split("one") == ["one"]


def test_no_character_is_lost(model, texts):
    for t in texts:
        got = model.split(t)
        assert re.sub(r"\s", "", "".join(got)) == re.sub(r"\s", "", t or "") and all(s.strip() for s in got)


def test_rows_have_the_models_sentences(frame, model, texts):
    got = collections.defaultdict(list)
    for r in explode_trained(frame, "text", model, 10, 60).orderBy("doc_id", "sent_idx").collect():
        got[r.doc_id].append((r.sent_idx, r.sent_total, r.sent_text))
    for i, t in enumerate(texts):
        want = [s for s in model.split(t) if 10 <= len(s) <= 60]
        assert got[i] == [(k, len(want), s) for k, s in enumerate(want)]


def test_texts_without_anything_to_learn(spark):
    empty = train_sentence_model(spark.createDataFrame([(None,), ("",)], "text string"))
    assert empty == SentenceModel() and empty.split("One. Two.") == ["One.", "Two."]
    assert train_sentence_model(spark.createDataFrame([("A. B. C.",)], "text string")).abbreviations == set()


def test_a_long_text_without_ends(model):
    text = "e.g. " * 200_000
    assert model.split(text) == [text]


def test_tokens_alone_give_the_same_types(frame):
    """Types are made of distinct tokens, after these have been counted."""
    key = lambda df: sorted(map(tuple, df.collect()))
    alone = M.token_counts(frame, "text")
    assert key(M.type_counts(alone)) == key(M.type_counts(M.neighbour_counts(frame, "text")))
    assert alone.count() < sum(len((t or "").split()) for (t,) in frame.select("text").collect()) / 10


def test_packed_types(model):
    words = {"valve", "e.g", "ärzte", "été", "", "zz", "a" * 300}
    packed = M.Types(words)
    assert set(packed) == words and len(packed) == len(words) and all(w in packed for w in words)
    assert not {"valv", "valves", "A", "zzz"} & {w for w in ("valv", "valves", "A", "zzz") if w in packed} and "a" not in M.Types()
    many = [f"type{i}" for i in range(10_000)]
    assert sum(len(getattr(M.Types(many), c)) for c in ("text",)) < 10_000 * 12 and isinstance(model.lower, M.Types)


def test_pairs_without_a_type_before_dont_meet_in_one_task(spark):
    """F16: most pairs have no type before them, and a join by it would send them all to one task."""
    rows = [("-", None, f"w{i}", False, "l", 1) for i in range(400)] + [(".", "dr", "smith", False, "u", 3), (".", "end", "the", False, "u", 2), ("^", None, "a", False, "u", 1)]
    pairs = spark.createDataFrame(rows, "before string, before_type string, type string, stop boolean, letter string, n long")
    short = spark.createDataFrame([("dr", 1.0)], "type string, score double")
    places = M.marked(pairs, short)
    assert sorted((r.type, r.place) for r in places.filter("before <> '-'").collect()) == [("a", "b"), ("smith", "?"), ("the", "b")]
    assert places.filter("place = 'm'").count() == 400 and places.count() == len(rows)

    plan = places._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Join") and "isnotnull(before_type" in plan


def test_no_type_is_dropped_from_large_sets(spark, texts):
    """sets of more than `most` types used to lose the rarer ones; now they are looked up in files."""
    texts = [*texts, "The cell, approx. Lung and cf. Valve, the Heart e.g. Heart. The lung, cf. Muscle.", "a.\u3000B. C.\xa0Dr.\u2003Lung. The cell."]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model = train_sentence_model(frame)
    assert len(model.capital_starts) > 1 and len(model.lower) > len(model.capital_starts) and len(model.collocations) > 1
    for most in (1, 0):
        stored = train_sentence_model(frame, most=most)
        assert stored == model and len(stored.lower) == len(model.lower)
        assert isinstance(stored.lower, M.StoredTypes) and isinstance(stored.collocations, M.StoredPairs) and isinstance(stored.abbreviations, M.StoredTypes)
        assert [stored.split(t) for t in texts] == [model.split(t) for t in texts]
        rows = lambda m: sorted(map(tuple, explode_trained(frame, "text", m).collect()))
        assert rows(stored) == rows(model)  # in workers


def test_stored_types(spark):
    """types in sorted files, several of them, are found and others aren't."""
    from litgraph.plans.stage import kept_lines

    rng = random.Random(3)
    words = {"", "é", "ärzte", "zz", "\xa0", "日本", "a" * 3000} | {"".join(rng.choice("abcé\U0001f600") for _ in range(rng.randrange(1, 7))) for _ in range(2000)}
    lines = spark.createDataFrame([(w,) for w in words], "line string")
    dealt = lines.repartitionByRange(7, "line").sortWithinPartitions("line")
    stored = M.StoredTypes(kept_lines(dealt))
    assert len(stored.files) > 3 and len(stored) == len(words) and stored == M.Types(words)
    assert all(w in stored for w in words)
    others = {w + c for w in words for c in "ab\U0001f600"} | {w[:-1] for w in words} | {"\n", "a\nb", "\U0010ffff"}
    assert not any(w in stored for w in others - words)
    one = M.StoredTypes(kept_lines(spark.createDataFrame([("",)], "line string")))
    assert "" in one and "a" not in one and list(one) == [""]
