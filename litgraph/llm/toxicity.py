"""Toxicity with a linear-chain conditional random field.

Words carry one of two tags, clean or toxic. Documents are labelled, words are not, so training labels words first: a greedy cover picks
the words and word beginnings that occur in toxic documents and hardly ever in others, the one that explains most unexplained toxic
documents first, until none explains five and 1.5 per cent of them (labels are noisy); a word of a toxic document with such a feature is tagged toxic. The field is then
fitted to these tags by gradient ascent on its likelihood, with the word, its beginnings and its endings as hashed features.

A document's score comes from forward-backward marginals: from the largest one and from the expected number of toxic words, through a
logistic calibration on the training documents. Offending offsets are the byte ranges of words whose marginal is at least one half.

Edge cases: null, empty and wordless texts have the lowest score and no offsets; repeated rows get equal scores; of a very long text only
numbers are held, two a word, since its words are read from a mebibyte at a time; with no labelled
document of one of the classes nothing can be learnt and every score is 1 or 0, as the labels say (0 without labels).
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_list, crc_mod, in_child, release, slices, table, text_parts, words_of
from .lanes import Lanes

PER_CLASS = 1500
SIZE = 1 << 18
THRESHOLD = 0.7
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def feature_names(word: bytes) -> list[bytes]:
    """The word, its beginnings of three to six letters and its endings of three and four."""
    text = word.decode(errors="replace")
    return [b"w:" + word, *(b"p:" + text[:n].encode() for n in (3, 4, 5, 6) if len(text) > n), *(b"s:" + text[-n:].encode() for n in (3, 4) if len(text) > n)]


def feature_ids(word: bytes) -> list[int]:
    return [zlib.crc32(f) % SIZE for f in feature_names(word)]


def signal_features(documents: list[tuple[list[bytes], int]], ratio: float = 20.0, least: float = 0.015) -> set[bytes]:
    """Words and beginnings of four letters or more that mark toxic documents; see the module's text."""
    where: dict[bytes, set[int]] = defaultdict(set)
    clean: Counter = Counter()
    n_toxic = sum(y for _, y in documents)
    n_clean = len(documents) - n_toxic
    toxic_words = {w for words, y in documents if y for w in words}
    names = {w: [f for f in feature_names(w) if f[:2] == b"w:" or f[:2] == b"p:" and len(f.decode(errors="replace")) >= 6] for w in toxic_words}
    for i, (words, y) in enumerate(documents):
        own = {f for w in set(words) if w in names for f in names[w]}
        if y:
            for f in own:
                where[f].add(i)
        else:
            clean.update(own)
    good = {f: s for f, s in where.items() if len(s) / n_toxic >= ratio * (clean[f] + 0.5) / (n_clean + 1)}
    out, left = set(), {i for i, (_, y) in enumerate(documents) if y}
    while left:
        gains = {f: len(s & left) for f, s in good.items()}
        best = max(gains, key=lambda f: (gains[f], len(f), f), default=None)
        if best is None or gains[best] < max(5, least * n_toxic):
            break
        out.add(best)
        left -= good.pop(best)
        good = {f: s for f, s in good.items() if gains[f] >= max(5, least * n_toxic)}
    # A feature also counts that is as specific to toxic documents and as frequent as those picked, although others explain its documents.
    return out | {f for f, s in where.items() if len(s) >= max(5, 0.05 * n_toxic) and clean[f] == 0 and f[:2] == b"w:"}


class ToxicField:
    """Two tags. `emission` of a word is its toxic less its clean score; transition[a, b] goes from tag a to tag b."""

    def __init__(self) -> None:
        self.weights = np.zeros(SIZE)
        self.bias = -3.0
        self.transition = np.zeros((2, 2))
        self.calibration = np.array([0.0, 0.0, 0.0])

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        return np.array([self.bias + self.weights[feature_ids(w)].sum() for w in words])

    def marginals(self, emission: np.ndarray, lengths: np.ndarray, width: int = 256):
        """Probability of the toxic tag for each word, and with it what training needs: lanes, forward and backward odds."""
        lanes = Lanes(lengths, width)
        e = np.exp(np.clip(lanes.place(emission, 0.0), -30, 30))
        t = np.exp(self.transition)
        forward = np.empty_like(e)
        odds = np.ones(lanes.width)
        for k in range(lanes.steps):
            n = lanes.active[k]
            o = odds[:n]
            stepped = np.where(lanes.starts[k, :n], 1.0, (t[1, 1] * o + t[0, 1]) / (t[1, 0] * o + t[0, 0]))
            odds = stepped * e[k, :n]
            forward[k, :n] = odds
        backward = np.ones_like(e)
        for k in range(lanes.steps - 2, -1, -1):
            n = lanes.active[k + 1]
            o = e[k + 1, :n] * backward[k + 1, :n]
            backward[k, :n] = np.where(lanes.starts[k + 1, :n], 1.0, (t[1, 1] * o + t[1, 0]) / (t[0, 1] * o + t[0, 0]))
        both = lanes.collect(forward) * lanes.collect(backward)
        return both / (1 + both), lanes, forward, backward, e

    def pair_marginals(self, lanes: Lanes, forward, backward, e) -> np.ndarray:
        """Expected transitions, summed over all neighbours of one sequence."""
        t, out = np.exp(self.transition), np.zeros((2, 2))
        for k in range(1, lanes.steps):
            n = lanes.active[k]
            inner = ~lanes.starts[k, :n]
            f, b = forward[k - 1, :n][inner], (e[k, :n] * backward[k, :n])[inner]
            cell = np.stack([t[0, 0] + 0 * f, t[0, 1] * b, t[1, 0] * f, t[1, 1] * f * b])
            out += (cell / cell.sum(0)).sum(1).reshape(2, 2)
        return out

    def fit(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray, y: np.ndarray, rounds: int = 40, rate: float = 0.5, ridge: float = 1e-4) -> None:
        """AdaGrad on the mean log-likelihood of all sequences: `flat` are places in `words`, y their tags, and lengths those of the sequences."""
        n = np.zeros(len(words), np.int32)

        def all_features():
            for i, w in enumerate(words):
                found = feature_ids(w)
                n[i] = len(found)
                yield from found

        feature = np.fromiter(all_features(), np.int32)
        word_of, ids, y = np.repeat(np.arange(len(words), dtype=np.int32), n), words, y.astype(float)
        scale = max(1.0, y.sum())
        seen = np.zeros((2, 2))
        inner = np.ones(len(y), bool)
        inner[np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(int)] = False
        np.add.at(seen, (y[:-1][inner[1:]].astype(int), y[1:][inner[1:]].astype(int)), 1)
        g_w, g_b, g_t = np.full(SIZE, 1e-6), 1e-6, np.full((2, 2), 1e-6)
        for _ in range(rounds):
            per_word = self.bias + np.bincount(word_of, self.weights[feature], len(ids))
            p, *state = self.marginals(per_word[flat], lengths)
            d_word = np.bincount(flat, y - p, len(ids)) / scale
            d = np.bincount(feature, d_word[word_of], SIZE) - ridge * self.weights
            g_w += d * d
            self.weights += rate * d / np.sqrt(g_w)
            d_bias = (y - p).sum() / scale
            g_b += d_bias * d_bias
            self.bias += 0.3 * rate * d_bias / np.sqrt(g_b)
            d_t = (seen - self.pair_marginals(*state)) / scale - ridge * self.transition
            g_t += d_t * d_t
            self.transition = np.clip(self.transition + 0.3 * rate * d_t / np.sqrt(g_t), -4, 4)

    def emissions(self, data: bytes | None, cache: dict[bytes, float]) -> np.ndarray:
        """Of a text's words. `cache` holds the scores of words."""
        out = []
        for part in text_parts(data):
            words = words_of(part)
            found = list(map(cache.get, words))
            if None in found:
                fresh = [w for w in dict.fromkeys(words) if w not in cache]
                if len(cache) > 100_000:
                    cache.clear()
                    fresh = list(dict.fromkeys(words))
                cache.update(zip(fresh, self.word_scores(fresh).tolist(), strict=True))
                found = list(map(cache.__getitem__, words))
            out.append(np.array(found, np.float64))
        return np.concatenate(out)

    def evidence(self, emissions: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Two numbers a document (log-odds of the largest marginal, logarithm of one plus the expected toxic words), and where they are."""
        lengths = np.array([len(e) for e in emissions])
        x = np.zeros((len(emissions), 2))
        x[:, 0] = -8
        places = [np.zeros(0, np.int64)] * len(emissions)
        if lengths.sum():
            p = self.marginals(np.concatenate(emissions), lengths)[0]
            own = np.flatnonzero(lengths)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            at = starts[:-1][own]
            top = np.clip(np.maximum.reduceat(p, at), 1e-4, 1 - 1e-4)
            x[own, 0] = np.clip(np.log(top / (1 - top)), -8, 8)
            x[own, 1] = np.log1p(np.add.reduceat(np.where(p >= 0.5, p, 0), at))
            for i in own[top >= 0.5].tolist():
                places[i] = np.flatnonzero(p[starts[i] : starts[i + 1]] >= 0.5)
        return x, places

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> None:
        """Logistic regression by Newton steps; the evidence can only raise a score."""
        a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(3)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.eye(3) * ridge * len(y) / 100, a.T @ (y - p) - ridge * len(y) / 100 * w)
        w[:2] = np.maximum(w[:2], 0)
        self.calibration = w

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.calibration[:2] + self.calibration[2], -30, 30)))


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS) -> DataFrame:
    """Texts and labels of about per_class labelled ids of each class (all, if fewer), one label (the larger) for each id. The ids are
    sampled before they meet the texts, so what is broadcast has that bound, and texts aren't shuffled."""
    own = labels.filter(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key).agg(F.max(label).alias(label))
    share = F.lit(0)
    for k, n in own.groupBy(label).count().collect():
        share = F.when(F.col(label) == k, F.lit(int((1 << 31) * min(1.0, per_class / n)))).otherwise(share)
    return docs.join(F.broadcast(own.filter(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < share)), key)


def train_field(rows: DataFrame, text: str = "text", label: str = "toxic") -> ToxicField:
    """From rows of text and label, which must be a bounded sample: one task reads them all and returns the model, so the driver's memory
    holds nothing but that, and a lost executor costs one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = {t: y for b in batches for t, y in zip(byte_list(b, text), b.column(label).to_pylist(), strict=True)}
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(in_child(fitted, sample))], pa.binary())], ["model"])

    own = rows.filter(F.length(F.trim(text)) > 0).select(text, F.col(label).cast("int").alias(label)).repartition(1)
    found = own.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fitted({})


def fitted(sample: dict[bytes, int]) -> ToxicField:
    """The field of labelled texts. Equal texts train once."""
    field = ToxicField()
    if len(set(sample.values())) < 2:
        field.calibration = np.array([0.0, 0.0, 20.0 if 1 in sample.values() else -20.0])
        return field
    # Words are numbers from here on, and a word's bytes are held once.
    vocabulary: dict[bytes, int] = {}
    texts, documents = sorted(sample), []
    for t in texts:
        documents.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int32))
    words, toxic = list(vocabulary), [sample[t] for t in texts]
    del vocabulary
    signals = signal_features([([words[i] for i in np.unique(d).tolist()], y) for d, y in zip(documents, toxic, strict=True)])
    marked = np.array([any(f in signals for f in feature_names(w)) for w in words], bool)
    lengths = [n for d in documents for n in [*[400] * (len(d) // 400), len(d) % 400] if n]  # all of a text in segments; scoring runs over whole texts
    tags = np.concatenate([marked[d] & bool(y) for d, y in zip(documents, toxic, strict=True)])
    field.fit(words, np.concatenate(documents), np.array(lengths), tags)
    del words, marked, tags, documents
    cache: dict[bytes, float] = {}
    x, _ = field.evidence([field.emissions(t, cache) for t in texts])
    field.calibrate(x, np.array(toxic, float))
    return field


def score_toxicity(docs: DataFrame, field: ToxicField, text: str = "text", offsets: bool = True) -> DataFrame:
    """docs with toxic_score and, if asked for, toxic_spans (byte offsets start, end, start, end, ... of offending words)."""
    docs = docs.drop("toxic_score", "toxic_spans")
    kept, held = docs.columns, docs.sparkSession.sparkContext.broadcast(field)
    added = [T.StructField("toxic_score", T.DoubleType()), *([T.StructField("toxic_spans", T.ArrayType(T.IntegerType()))] if offsets else [])]

    def run(batches):
        model, cache = held.value, {}
        for b in slices(batches, text, rows=1024):
            data = byte_list(b, text)
            x, places = model.evidence([model.emissions(d, cache) for d in data])
            columns = [pa.array(model.scores(x))]
            if offsets:
                columns.append(pa.array([_byte_spans(d, p) for d, p in zip(data, places, strict=True)], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *columns], [*kept, *(f.name for f in added)])
        cache.clear()
        release()

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _byte_spans(data: bytes | None, places: np.ndarray) -> list[int]:
    if not len(places):
        return []
    spans = [m.span() for m in _WORD.finditer(data)]
    return [v for p in places.tolist() for v in spans[p]]


def learn(docs: DataFrame, labels: DataFrame) -> ToxicField:
    """From the rows whose crc32(doc_id) mod 3 is not 1."""
    own = docs.filter(crc_mod("doc_id", 3) != 1).select("doc_id", "text")
    return train_field(training_rows(own, labels.filter(crc_mod("doc_id", 3) != 1).select("doc_id", "toxic")))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = learn(docs, table(spark, sf_dir, "labels"))
    found = score_toxicity(docs, field, offsets=False)
    return found.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), F.col("toxic_score").alias("score"), F.when(F.col("toxic_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
