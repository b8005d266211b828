"""Latent Dirichlet allocation by variational inference whose word table stays a partitioned table.

Documents are dealt to blocks. A block's bags are packed once into whole numbers: how many different words each document has, their places in
the block's own list of words, and how often they occur. In a round, each block receives the rows of the words that its documents hold, once
each, fits its documents' mixes, and gives back what its words add to the topics; these are summed by word and become the next table. Words go
by numbers there, so a round moves no text. The driver holds one number for each topic, whatever the vocabulary. Sums are of whole numbers (2**-20 of
an occurrence), and the first table comes from hashes of the words, so equal seeds give equal topics however rows were split.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import drop, scratch
from .ordering import top_per_group

#: Words of a block times topics, about; steps of a block's own fit; parts of an occurrence.
BLOCK, STEPS, UNIT = 5 << 20, 12, float(1 << 20)


def digamma(x: np.ndarray) -> np.ndarray:
    """The derivative of the logarithm of the gamma function, for positive numbers: the recurrence up to 6, then the asymptotic series."""
    x, out = np.array(x, float), np.zeros(np.shape(x))
    for _ in range(6):
        low = x < 6
        out = np.where(low, out - 1 / x, out)
        x = np.where(low, x + 1, x)
    y = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def postings(bags: list, place: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, word, count) of the bags' words that have a place."""
    doc = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    word = np.fromiter((place.get(w, -1) for b in bags for w in b), np.int64, len(doc))
    known = word >= 0
    key, n = np.unique(doc[known] * max(len(place), 1) + word[known], return_counts=True)
    return key // max(len(place), 1), key % max(len(place), 1), n.astype(float)


def fit_block(doc: np.ndarray, word: np.ndarray, n: np.ndarray, beta: np.ndarray, docs: int, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """The documents' topic weights (documents x topics) and what each word adds to each topic, given exp(E[log beta]) of the words."""
    k = beta.shape[1]
    own, gamma = [beta[word, i] for i in range(k)], np.full((docs, k), 1.0)  # a topic at a time, so that no step goes along short rows

    def shares(gamma: np.ndarray) -> list[np.ndarray]:
        theta = np.exp(digamma(gamma) - digamma(gamma.sum(axis=1, keepdims=True)))
        parts = [theta[doc, i] * own[i] for i in range(k)]
        scale = n / (sum(parts) + 1e-100)
        return [p * scale for p in parts]

    for _ in range(STEPS):
        new = alpha + np.stack([np.bincount(doc, p, docs) for p in shares(gamma)], axis=1)
        done = np.abs(new - gamma).mean() < 1e-3
        gamma = new
        if done:
            break
    return gamma, np.stack([np.bincount(word, p, len(beta)) for p in shares(gamma)], axis=1)


@dataclass
class Blocks:
    """packed: a row for each block with `_block`, `rows` (its documents' numbers), `size` (how many words its list has), and as bytes `different`
    (of each document), `place` and `n`; needs: `_block`, `place` and `wid`, the number of the word there, of words that the model knows."""

    packed: DataFrame
    needs: DataFrame


def as_bytes(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on, in as few bytes each as the largest needs."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0)))).tobytes()


def from_bytes(held: bytes, count: int) -> np.ndarray:
    return np.frombuffer(held, f"u{len(held) // max(count, 1) or 1}").astype(np.int64)


def pack(bags: pa.Table) -> pa.Table:
    """The packed row of a block's documents (_block, _row, bag), with the list of its words and how many documents hold each."""
    bags = bags.sort_by("_row")
    column = pa.concat_arrays(bags.column("bag").chunks)
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    index = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False)
    doc = np.repeat(np.arange(len(sizes)), sizes)[index >= 0]
    key, n = np.unique(doc * max(len(order), 1) + rank[index[index >= 0]], return_counts=True)
    doc, place = key // max(len(order), 1), key % max(len(order), 1)
    row = {
        "_block": bags.column("_block")[0].as_py(), "rows": bags.column("_row").to_numpy(), "size": len(order), "different": as_bytes(np.bincount(doc, minlength=len(sizes))),
        "place": as_bytes(place), "n": as_bytes(n), "words": coded.dictionary.take(pa.array(order)).to_pylist(), "df": np.bincount(place, minlength=len(order)),
    }
    types = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.table({c: pa.array([v], t) for (c, v), t in zip(row.items(), types)})


def unpack(row: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The documents' numbers, and document, place and count of each posting."""
    one = {c: row.column(c)[0] for c in ("rows", "different", "place", "n")}
    rows = one["rows"].values.to_numpy()
    doc = np.repeat(np.arange(len(rows)), from_bytes(one["different"].as_py(), len(rows)))
    return rows, doc, from_bytes(one["place"].as_py(), len(doc)), from_bytes(one["n"].as_py(), len(doc)).astype(float)


@dataclass
class TopicModel:
    """words: wid, a word's number, and t0, t1, ... (its weight in each topic), after training with the word; totals: of each topic."""

    words: DataFrame
    totals: np.ndarray
    alpha: float

    @property
    def k(self) -> int:
        return len(self.totals)

    def in_blocks(self, blocks: Blocks, work, schema: str) -> DataFrame:
        """work(documents' numbers, document, word and count of the postings, the words' numbers, their weights) for each block."""
        names = [f"t{i}" for i in range(self.k)]
        weights = blocks.needs.join(self.words, "wid").select("_block", "place", "wid", *names)

        def one(packed: pa.Table, held: pa.Table) -> pa.Table:
            rows, doc, place, n = unpack(packed)
            held = held.sort_by("place")
            word = np.full(packed.column("size")[0].as_py(), -1, np.int64)
            word[held.column("place").to_numpy()] = np.arange(held.num_rows)
            word = word[place]
            known = word >= 0
            return work(rows, doc[known], word[known], n[known], held.column("wid"), np.stack([held.column(c).to_numpy() for c in names], axis=1))

        packed = blocks.packed.select("_block", "rows", "size", "different", "place", "n")
        return packed.groupBy("_block").cogroup(weights.groupBy("_block")).applyInArrow(one, schema)

    def heaviest(self, most: int = 10) -> DataFrame:
        """topic, word and weight (its share of the topic) of each topic's heaviest words."""
        share = F.array(*(F.struct(F.lit(i).alias("topic"), (F.col(f"t{i}") / float(t)).alias("weight")) for i, t in enumerate(self.totals)))
        rows = self.words.select("word", F.explode(share).alias("s")).select("s.topic", "word", "s.weight")
        return top_per_group(rows, ["topic"], [F.desc("weight"), F.col("word")], most).select("topic", "word", "weight").orderBy("topic", F.desc("weight"), "word")


def dealt(docs: DataFrame, bow: str, k: int) -> tuple[DataFrame, DataFrame]:
    """The documents, written, with a number each, and their blocks as `pack` makes them, written."""
    rows = scratch(docs.withColumn("_row", F.monotonically_increasing_id()))
    words = rows.agg(F.sum(F.greatest(F.size(bow), F.lit(1)).cast("long"))).first()[0] or 0
    block = F.pmod(F.xxhash64(bow), F.lit(max(1, -(-words * k // BLOCK)))).alias("_block")
    schema = "_block long, rows array<long>, size long, different binary, place binary, n binary, words array<string>, df array<long>"
    return rows, scratch(rows.select(block, "_row", F.col(bow).alias("bag")).groupBy("_block").applyInArrow(pack, schema))


def train_topics(docs: DataFrame, bow: str, k: int = 20, rounds: int = 50, seed: int = 7, least_df: int = 2) -> tuple[TopicModel, DataFrame, Blocks]:
    """A model of the bags' words that `least_df` documents hold, the numbered documents, and their blocks. Priors are 1 / k, as is usual. Topics
    are numbered by their heaviest words, in order."""
    rows, packed = dealt(docs, bow, k)
    words = packed.select("_block", F.posexplode(F.arrays_zip("words", "df")).alias("place", "w")).select("_block", "place", F.col("w.words").alias("word"), F.col("w.df").alias("df"))
    df = words.groupBy("word").agg(F.sum("df").alias("df"))
    known = scratch(df.filter(F.col("df") >= least_df).select("word", F.monotonically_increasing_id().alias("wid")))
    blocks = Blocks(packed, scratch(words.join(known, "word").select("_block", "place", "wid")))
    prior = 1.0 / k
    names = [f"t{i}" for i in range(k)]
    first = [(0.5 + F.pmod(F.xxhash64("word", F.lit(i), F.lit(seed)), F.lit(1 << 20)) / F.lit(UNIT)).alias(c) for i, c in enumerate(names)]

    def weighted(table: DataFrame) -> TopicModel:
        words = scratch(table)
        totals = words.agg(*(F.sum(F.round(F.col(c) * UNIT).cast("long")) for c in names)).first()
        return TopicModel(words, np.array([(t or 1) / UNIT for t in totals], float), prior)

    model = weighted(known.select("wid", *first))
    schema = "wid long, " + ", ".join(f"{c} long" for c in names)
    for _ in range(rounds):
        base = digamma(model.totals)

        def work(rows, doc, word, n, wids, weights, base=base) -> pa.Table:
            _, added = fit_block(doc, word, n, np.exp(digamma(np.maximum(weights, 1e-9)) - base), len(rows), prior)
            return pa.table({"wid": wids} | {c: pa.array(np.rint(added[:, i] * UNIT).astype(np.int64)) for i, c in enumerate(names)})

        added = model.in_blocks(blocks, work, schema).groupBy("wid").agg(*(F.sum(c).alias(c) for c in names))
        after = weighted(known.select("wid").join(added, "wid", "left").select("wid", *((F.coalesce(c, F.lit(0)) / UNIT + prior).alias(c) for c in names)))
        drop(model.words)
        model = after
    named = TopicModel(model.words.join(known, "wid"), model.totals, prior)
    first = {r.topic: r.word for r in named.heaviest(1).collect()}  # one row for each topic
    order = sorted(range(k), key=lambda i: (i not in first, first.get(i, ""), i))
    words = scratch(named.words.select("word", "wid", *(F.col(names[j]).alias(c) for c, j in zip(names, order))))
    drop(model.words, known)
    return TopicModel(words, model.totals[order], prior), rows, blocks


def mixes(model: TopicModel, rows: DataFrame, bow: str, blocks: Blocks) -> DataFrame:
    """The documents with topics, their shares of each topic; zeros where a document has no known word."""
    base, alpha = digamma(model.totals), model.alpha

    def work(rows, doc, word, n, wids, weights) -> pa.Table:
        gamma, _ = fit_block(doc, word, n, np.exp(digamma(np.maximum(weights, 1e-9)) - base), len(rows), alpha)
        share = gamma / gamma.sum(axis=1, keepdims=True)
        share[np.setdiff1d(np.arange(len(rows)), doc)] = 0
        topics = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * model_k), pa.array(share.ravel()))
        return pa.table({"_row": pa.array(rows), "topics": topics})

    model_k = model.k
    found = model.in_blocks(blocks, work, "_row long, topics array<double>")
    return rows.join(found, "_row").drop("_row")


def log_likelihood(model: TopicModel, rows: DataFrame, bow: str, blocks: Blocks) -> float:
    """Mean natural logarithm of a known word's probability, by the documents' mixes and the topics' mean weights."""
    base, totals, alpha = digamma(model.totals), model.totals, model.alpha

    def work(rows, doc, word, n, wids, weights) -> pa.Table:
        gamma, _ = fit_block(doc, word, n, np.exp(digamma(np.maximum(weights, 1e-9)) - base), len(rows), alpha)
        p = ((gamma / gamma.sum(axis=1, keepdims=True))[doc] * (weights / totals)[word]).sum(axis=1)
        return pa.table({"logs": [float((n * np.log(p)).sum())], "n": [float(n.sum())]})

    total = model.in_blocks(blocks, work, "logs double, n double").agg(F.sum("logs"), F.sum("n")).first()
    return total[0] / total[1] if total[1] else 0.0


def fit_topics(docs: DataFrame, bow: str, k: int = 20, rounds: int = 50, seed: int = 7, least_df: int = 2) -> tuple[DataFrame, DataFrame]:
    """The document mixes (column topics: array of k weights) and the topics (topic, word, weight; the ten heaviest words)."""
    model, rows, blocks = train_topics(docs, bow, k, rounds, seed, least_df)
    return mixes(model, rows, bow, blocks), model.heaviest(10)
