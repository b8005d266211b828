"""Frequent phrases of two and three words, level by level, and their places in texts, without a row for each n-gram of each text.

A phrase can only reach the support if its words do, and a phrase of three words only if both its pairs of neighbours do. So words are
counted first, then pairs of frequent words, then triples of frequent pairs; each level is one pass over the texts, whose tasks add up their
own counts before anything is exchanged. Frequent words have numbers, and a phrase is up to three of them in one whole number: counts are
exact, and what is exchanged is two numbers for each phrase that a task saw.

Texts are annotated where they lie, by a look-up in the sorted numbers of the model. The vocabulary (fewer than 2**20 words) and the model
(at most MOST phrases, 64 MB) are broadcast after they have been counted; beyond either size `mine` and `annotate` take the way of
`ngrams`, which joins strings and has no such bound.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_interesting
from ..plans.stage import drop, scratch
from . import ngrams

BITS = 20
#: Phrases of a broadcast model; counts that a task holds before it passes them on.
MOST, HELD = 1 << 23, 1 << 21


class Tally:
    """Counts of whole numbers, merged now and then."""

    def __init__(self) -> None:
        self.parts, self.size = [], 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        if len(keys):
            k, at = np.unique(keys, return_inverse=True)
            self.parts.append((k, np.bincount(at, n, len(k)).astype(np.int64)))
            self.size += len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) > 1:
            keys, n = (np.concatenate(x) for x in zip(*self.parts))
            self.parts, self.size = [], 0
            self.add(keys, n)
        return self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def batch(self) -> pa.RecordBatch:
        keys, n = self.merged()
        self.parts, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["k", "n"])


def contains(model: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys are among the sorted numbers of a model."""
    if not len(model):
        return np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(model, keys), len(model) - 1)
    return model[at] == keys


def flat_words(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the rows of a list column, and the number of each row's."""
    return column.flatten(), np.array([n or 0 for n in pc.list_value_length(column).to_pylist()], np.int64)


@dataclass
class Phrases:
    """words: the vocabulary; a word's number is its place. good: whether it may begin or end a phrase. model: of pairs and of triples, sorted
    numbers and their counts."""

    words: pa.Array
    good: np.ndarray
    pairs: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    triples: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def numbers(self, flat: pa.Array, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place the number of the phrase of `width` words there, and whether there is one: all words known, of one row."""
        ids = pc.fill_null(pc.index_in(flat, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(sizes)), sizes)
        n = max(len(ids) - width + 1, 0)
        key, there = np.zeros(n, np.int64), row[:n] == row[len(ids) - n :] if n else np.zeros(0, bool)
        for j in range(width):
            key = key << BITS | np.maximum(ids[j : j + n], 0)
            there = there & (ids[j : j + n] >= 0)
        return key, there

    def ends_good(self, keys: np.ndarray, width: int) -> np.ndarray:
        return self.good[keys >> BITS * (width - 1)] & self.good[keys & (1 << BITS) - 1]

    def counted(self, rows: DataFrame, lemmas: str, width: int, support: int, pairs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers and counts of the phrases of `width` words with the support; None where there are more than MOST. Triples need good
        ends and, if given, frequent pairs."""

        def work(batches):
            tally = Tally()
            for b in batches:
                flat, sizes = flat_words(b.column(0))
                key, there = self.numbers(flat, sizes, width)
                key = key[there]
                if width == 3:
                    key = key[self.ends_good(key, 3)]
                    if pairs is not None:
                        key = key[contains(pairs, key >> BITS)]
                        key = key[contains(pairs, key & (1 << 2 * BITS) - 1)]
                tally.add(key)
                if tally.size > HELD:
                    tally.merged()
                if tally.size > HELD:
                    yield tally.batch()
            yield tally.batch()

        found = scratch(rows.select(lemmas).mapInArrow(work, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= support))
        if found.count() > MOST:
            drop(found)
            return None
        table = found.orderBy("k").toArrow()
        drop(found)
        return tuple(table.column(c).to_numpy().astype(np.int64) for c in ("k", "n"))

    def table(self, spark) -> DataFrame:
        """ngram and n of all phrases of the model."""
        out = []
        for width, (keys, n) in ((2, self.pairs), (3, self.triples)):
            parts = [self.words.take(pa.array(keys >> BITS * (width - 1 - j) & (1 << BITS) - 1)) for j in range(width)]
            out.append(pa.table({"ngram": pc.binary_join_element_wise(*parts, "_"), "n": pa.array(n)}))
        return spark.createDataFrame(pa.concat_tables(out).cast(pa.schema([("ngram", pa.string()), ("n", pa.int64())])))

    def annotate(self, rows: DataFrame, key: str, lemmas: str) -> DataFrame:
        """key and ngrams: the model's phrases in each row's words from left to right, the longest at each place, without overlap."""
        model = {2: self.pairs[0], 3: self.triples[0]}

        def work(batches):
            for b in batches:
                flat, sizes = flat_words(b.column(1))
                width = np.zeros(len(flat), np.int64)
                for w in (2, 3):
                    k, there = self.numbers(flat, sizes, w)
                    at = np.flatnonzero(there)
                    at = at[contains(model[w], k[at])]
                    width[at] = w
                found, after = [], 0
                at = np.flatnonzero(width)
                for t, w in zip(at.tolist(), width[at].tolist()):
                    if t >= after:
                        found.append(t)
                        after = t + w
                found = np.array(found, np.int64)
                text = np.empty(len(found), object)
                for w in (2, 3):
                    own = np.flatnonzero(width[found] == w)
                    if len(own):
                        text[own] = pc.binary_join_element_wise(*(flat.take(pa.array(found[own] + j)) for j in range(w)), "_").to_numpy(zero_copy_only=False)
                ends = np.cumsum(sizes)
                offsets = np.concatenate([[0], np.searchsorted(found, ends)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(text.tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists], [key, "ngrams"])

        return rows.select(key, lemmas).mapInArrow(work, f"`{key}` {rows.schema[key].dataType.simpleString()}, ngrams array<string>")


def mine(rows: DataFrame, lemmas: str, support: int) -> Phrases | None:
    """The phrases of two or three words with the support that begin and end with an interesting word, from a column of word lists. None
    where the vocabulary or a level is too large to broadcast."""

    def words(batches):
        for b in batches:
            c = pc.value_counts(b.column(0).flatten().cast(pa.string()))
            yield pa.RecordBatch.from_arrays([c.field("values"), c.field("counts")], ["word", "n"])

    counted = rows.select(lemmas).mapInArrow(words, "word string, n long").filter("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = scratch(counted.filter(F.col("n") >= support).select("word", is_interesting(F.col("word")).alias("good")))
    if frequent.count() >= 1 << BITS:
        drop(frequent)
        return None
    table = frequent.orderBy("word").toArrow()
    drop(frequent)
    found = Phrases(table.column("word").combine_chunks().cast(pa.string()), table.column("good").to_numpy().astype(bool))
    pairs = found.counted(rows, lemmas, 2, support)
    triples = found.counted(rows, lemmas, 3, support, pairs and pairs[0])
    if pairs is None or triples is None:
        return None
    good = found.ends_good(pairs[0], 2)
    return Phrases(found.words, found.good, (pairs[0][good], pairs[1][good]), triples)


def mined_and_annotated(rows: DataFrame, key: str, lemmas: str, support: int) -> DataFrame:
    """key and ngrams of each row, with the phrases mined from all rows."""
    model = mine(rows, lemmas, support)
    if model is not None:
        return model.annotate(rows, key, lemmas)
    grams: Column = F.col(lemmas)
    return ngrams.annotate(rows, key, lemmas, ngrams.mine_ngrams(ngrams.ngram_rows(rows, grams, 3), support), 3)
