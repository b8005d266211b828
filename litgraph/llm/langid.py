"""Language identification with a byte convolutional network, trained in numpy.

A text's UTF-8 bytes (A-Z lower-cased) are cut into windows of WINDOW bytes that overlap by the widest filter less one, so every n-gram
of the whole text is seen. Filters of several widths slide over a window's byte embeddings; each filter's largest response feeds a
softmax over the languages. A document's score is the softmax of the mean log-probability over its windows.

For prediction, embedding and filters are folded into one table per filter offset: a response is a sum of table rows.

Edge cases: a null text or one without a letter is `und` with score 0; ties go to the language that sorts first; rows without a
language train nothing; with no training row at all every text is `und` with score 0; short windows are padded with spaces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, crc_mod_py, slices, table

WINDOW = 160
WIDTHS = (2, 3, 4)
FILTERS = 12
PER_LANGUAGE = 600
#: Windows that training goes through, epochs together, unless one epoch has more.
WINDOWS = 100_000
#: Letters, and numerals that are none (`isalpha` tells them apart).
_LETTER = re.compile(r"[^\W\d_]+")
_STEP = WINDOW - max(WIDTHS) + 1


def windows_of(data: bytes) -> np.ndarray:
    """(n, WINDOW) bytes."""
    data = data.lower()
    n = 1 if len(data) <= WINDOW else 1 + -(-(len(data) - WINDOW) // _STEP)
    padded = np.frombuffer(data.ljust((n - 1) * _STEP + WINDOW), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::_STEP]


class ByteCNN:
    def __init__(self, languages: list[str], seed: int = 3, embedding: int = 8) -> None:
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.emb = rng.normal(0, 0.5, (256, embedding)).astype(np.float32)
        self.filters = [rng.normal(0, 1 / np.sqrt(w * embedding), (w, embedding, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def _params(self) -> list[np.ndarray]:
        return [self.emb, *self.filters, self.bias, self.out, self.out_bias]

    def fold(self) -> list[np.ndarray]:
        """For each offset, a table byte -> responses of the filters that reach it, widest filters last."""
        return [np.ascontiguousarray(np.concatenate([self.emb @ f[j] for w, f in zip(WIDTHS, self.filters, strict=True) if w > j], 1)) for j in range(max(WIDTHS))]

    def pooled(self, x: np.ndarray, tables: list[np.ndarray], where: bool = False):
        """Largest response of each filter for windows x; with `where`, the places, too."""
        total = tables[0][x]
        for j in range(1, max(WIDTHS)):
            part = tables[j][x[:, j:]]
            total[:, : x.shape[1] - j, total.shape[2] - part.shape[2] :] += part
        best, at = [], []
        for k, w in enumerate(WIDTHS):
            own = total[:, : x.shape[1] - w + 1, k * FILTERS : (k + 1) * FILTERS]
            best.append(own.max(1))
            if where:
                at.append(own.argmax(1))
        best = np.concatenate(best, 1) + self.bias
        return (best, at) if where else best

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.004, seed: int = 5) -> None:
        """Adam on the cross entropy; gradients pass the max pooling to the places that won."""
        rng, params = np.random.default_rng(seed), self._params()
        m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                xb, step = x[own], step + 1
                best, at = self.pooled(xb, self.fold(), where=True)
                hidden = np.maximum(best, 0)
                p = softmax(hidden @ self.out + self.out_bias)
                p[np.arange(len(own)), y[own]] -= 1
                p /= len(own)
                d_out, d_out_bias = hidden.T @ p, p.sum(0)
                d = (p @ self.out.T) * (best > 0)
                d_emb, d_filters = np.zeros_like(self.emb), []
                rows = np.arange(len(own))[:, None]
                for k, (w, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
                    g, df = d[:, k * FILTERS : (k + 1) * FILTERS], np.zeros_like(f)
                    for j in range(w):
                        byte = xb[rows, at[k] + j]
                        df[j] = np.einsum("nf,nfe->ef", g, self.emb[byte])
                        np.add.at(d_emb, byte.ravel(), (g[:, :, None] * f[j].T[None]).reshape(-1, f.shape[1]))
                    d_filters.append(df)
                for q, g, a, b in zip(params, [d_emb, *d_filters, d.sum(0), d_out, d_out_bias], m, v, strict=True):
                    a += 0.1 * (g - a)
                    b += 0.01 * (g * g - b)
                    q -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)

    def predict(self, texts: list[bytes], chunk: int = 48) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its probability."""
        tables, parts = self.fold(), [windows_of(t) for t in texts]
        counts = np.array([len(p) for p in parts])
        logs = np.zeros((len(texts), len(self.languages)))
        owner, waiting, held = [], [], 0

        def flush():
            x, who = np.concatenate(waiting), np.concatenate(owner)
            for i in range(0, len(x), chunk):
                hidden = np.maximum(self.pooled(x[i : i + chunk], tables), 0)
                np.add.at(logs, who[i : i + chunk], np.log(softmax(hidden @ self.out + self.out_bias) + 1e-12))

        for k, p in enumerate(parts):
            for i in range(0, len(p), 4096):
                waiting.append(p[i : i + 4096])
                owner.append(np.full(len(waiting[-1]), k))
                held += len(waiting[-1])
                if held >= 4096:
                    flush()
                    owner, waiting, held = [], [], 0
        if held:
            flush()
        p = softmax(logs / np.maximum(counts, 1)[:, None])
        return p.argmax(1), p.max(1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def has_letter(text: str) -> bool:
    return any(any(map(str.isalpha, m[0])) for m in _LETTER.finditer(text))


def train_model(rows: DataFrame, key: str, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> ByteCNN | None:
    """From all windows of a sample of about per_language rows of each language (all, if fewer), picked by a hash of key. There are fewer
    epochs the more windows there are, six at most and one at least."""
    rows = rows.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not counts:
        return None
    share = F.lit(0)
    for k, n in counts.items():
        share = F.when(F.col(lang) == k, F.lit(int((1 << 31) * min(1.0, per_language / n)))).otherwise(share)
    sample = rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 31)) < share).select(F.col(lang).alias("lang"), F.col(text).alias("text")).collect()
    languages = sorted({r[0] for r in sample})
    x, y = [], []
    for r in sorted(sample):
        x.append(windows_of(r[1].encode()))
        y += [languages.index(r[0])] * len(x[-1])
    model = ByteCNN(languages)
    model.train(np.concatenate(x), np.array(y), epochs=max(1, min(6, WINDOWS // len(y))))
    return model


def identify(docs: DataFrame, model: ByteCNN | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score in place of any columns of these names."""
    docs = docs.drop("lang_pred", "lang_score")
    kept = docs.columns
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        net = held.value
        for b in slices(batches, text):
            texts = b.column(text).to_pylist()
            own = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
            pred, score = ["und"] * len(texts), [0.0] * len(texts)
            if own:
                best, p = net.predict([texts[i].encode() for i in own])
                for i, k, q in zip(own, best.tolist(), p.tolist(), strict=True):
                    pred[i], score[i] = net.languages[k], q
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(pred), pa.array(score, pa.float64())], [*kept, "lang_pred", "lang_score"])

    return docs.mapInArrow(run, _schema(docs))


def _schema(docs: DataFrame):
    from pyspark.sql import types as T

    return T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])


def held_out(doc_id, mod: int, rest: int) -> bool:
    return crc_mod_py(doc_id, mod) == rest


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train_model(docs.filter(crc_mod("doc_id", 4) != 2), "doc_id")
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
