"""Packing documents into training sequences by lexical retrieval.

Texts are tokenised once. A document's whole windows become sequences of their own; its tail waits for company. Document frequencies and
the mean length are those of all tails. Tails go to shards of about SHARD_DOCS documents by their words: cells of similar vectors (random
projections of inverse document frequencies) come one after another, a cell's tails lie in the order of two weighted minimum hashes, and
what is still equal in the order of row hashes, so that no key can fill a shard. This order is cut where shards have equal shares of a
sample. Each shard builds a BM25 inverted index of its tails' token ids. A seed, the first tail that waits, queries the index with its
rarest terms that another tail of the shard holds, and unused neighbours fill its window greedily, best first: whole ones while they fit,
then a part of the best one that is left, whose rest keeps waiting. Only a shard's last window can end short, so padding is at most one
window for each SHARD_DOCS documents.

Words between ASCII white space are tokenised alone and remembered, which gives the same ids for tokenizers that drop white space and
never merge across it; for others set `split_words` to False. How pieces of a word are cached doesn't change an id.

Edge cases: a null text is empty and has its end id only; repeated rows are packed each; a null id stays null and comes last in its shard;
ties in the retrieval score go to the document that comes first by id; a document longer than many windows fills them alone; an empty
table gives no row. Extra columns are left out.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, slices, table, written

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 2000
QUERY_TERMS = 48
K1, B = 1.2, 0.75
CELLS = 256
AXES = 48
CELL_SAMPLE = 4096
CUT_SAMPLE = 64


class WordTokenizer:
    """Ids of whole texts as little-endian bytes, through caches of words and of their pieces.

    Words between white space go to the tokenizer one by one, once each. Where its rules are the usual ones of lower-case byte-level
    models (checked in the definition), words of Latin letters, digits and ASCII signs are cut into pieces here, and only new pieces go
    to its merges; all other words take the tokenizer's own way.
    """

    def __init__(self, definition: str, split_words: bool, end_id: int, most: int = 400_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.dtype = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.split_words, self.most, self.cache, self.pieces = split_words, most, {}, {}
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.tokenize = self.tokenizer.model.tokenize
        self.end = np.array([end_id], self.dtype).tobytes()
        rules = json.loads(definition)
        self.plain = split_words and (rules["normalizer"], rules["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER) and not rules["model"].get("dropout")

    def _of_piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.tokenize(piece if piece.isascii() else "".join(map(_BYTE_CHARACTERS.__getitem__, piece.encode())))]
        found = self.pieces[piece] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return found

    def _of_words(self, words: list[bytes]) -> None:
        odd = []
        if len(self.pieces) > self.most:
            self.pieces.clear()
        known, cache = self.pieces.get, self.cache
        for w in words:
            if self.plain and w.isalpha():  # ASCII letters are one piece, and so is a single sign after them
                p = w.lower().decode()
                cache[w] = known(p) or self._of_piece(p)
                continue
            if self.plain and w[-1:] in _SIGNS and w[:-1].isalpha():
                p, sign = w[:-1].lower().decode(), w[-1:].decode()
                cache[w] = (known(p) or self._of_piece(p)) + (known(sign) or self._of_piece(sign))
                continue
            text = w.decode()
            if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
                cache[w] = b"".join([known(p) or self._of_piece(p) for p in _PIECE.findall(text.lower())])
            else:
                odd.append((w, text))
        for k in range(0, len(odd), 10_000):
            part = odd[k : k + 10_000]
            for (w, _), e in zip(part, self.tokenizer.encode_batch_fast([t for _, t in part], add_special_tokens=False), strict=True):
                cache[w] = np.array(e.ids, self.dtype).tobytes()

    def __call__(self, texts: list[bytes | None]) -> list[np.ndarray]:
        out = []
        for t in texts:
            units = (t or b"").split() if self.split_words else [t or b""]
            if len(self.cache) > self.most:
                self.cache.clear()
            found = list(map(self.cache.get, units))
            if None in found:
                self._of_words(list({w for w, x in zip(units, found, strict=True) if x is None}))
                found = list(map(self.cache.__getitem__, units))
            found.append(self.end)
            out.append(np.frombuffer(b"".join(found), self.dtype))
        return out


# The rules of the tokenizers that pieces may be cut for, and what they say for printable ASCII and Latin letters.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_SIGNS = frozenset((b".", b",", b";", b":", b"!", b"?"))
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
#: Byte-level models write printable bytes of Latin-1 as themselves and the others as characters from 256 on.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_CHARACTERS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


class Statistics:
    """Of all tails that aren't empty: their number, mean length, and for each id the tails that hold it."""

    def __init__(self, n: int, total: int, df: np.ndarray) -> None:
        self.n, self.mean, self.df = n, total / max(n, 1), df

    @staticmethod
    def of(documents: list[np.ndarray]) -> Statistics:
        df = np.zeros(1 + max((int(d.max()) for d in documents if len(d)), default=0), np.int64)
        for d in documents:
            df[np.unique(d)] += 1
        return Statistics(sum(len(d) > 0 for d in documents), sum(map(len, documents)), df)

    def idf(self, terms: np.ndarray | slice = slice(None)) -> np.ndarray:
        return np.log1p((self.n - self.df[terms] + 0.5) / (self.df[terms] + 0.5))


class Bm25Index:
    """Inverted index of a shard: for each term the documents that hold it, with their BM25 weights by the statistics of all tails."""

    def __init__(self, documents: list[np.ndarray], statistics: Statistics | None = None) -> None:
        statistics = statistics or Statistics.of(documents)
        lengths = np.array([len(d) for d in documents], np.int64)
        n = len(documents)
        flat = np.concatenate(documents).astype(np.int64) * n + np.repeat(np.arange(n), lengths)
        pairs, tf = np.unique(flat, return_counts=True)
        terms, self.docs = np.divmod(pairs, n)
        self.terms, self.begin, held = np.unique(terms, return_index=True, return_counts=True)
        self.end = self.begin + held
        self.idf = statistics.idf(self.terms)
        norm = K1 * (1 - B + B * lengths / statistics.mean)
        self.weights = np.repeat(self.idf, held) * tf * (K1 + 1) / (tf + norm[self.docs])
        self.n = n

    def search(self, ids: np.ndarray, terms: int = QUERY_TERMS) -> np.ndarray:
        """Documents with a positive score for the rarest terms of ids which two documents or more hold, best first."""
        own = np.searchsorted(self.terms, np.unique(ids))
        own = own[self.end[own] - self.begin[own] > 1]
        own = own[np.argsort(-self.idf[own], kind="stable")][:terms]
        if not len(own):
            return own
        begin, n = self.begin[own], self.end[own] - self.begin[own]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())
        score = np.bincount(self.docs[at], self.weights[at], self.n)
        found = np.flatnonzero(score > 0)
        return found[np.argsort(-score[found], kind="stable")]


class Deal:
    """Places of tails in one order in which tails with common rare terms are near each other, and the cuts of this order."""

    def __init__(self, statistics: Statistics) -> None:
        #: Terms of a single tail bring nothing together.
        self.idf = np.where(statistics.df > 1, statistics.idf(), 0).astype(np.float32)
        self.centers = np.zeros((1, AXES), np.float32)
        self.cuts = np.zeros(0, np.int64)
        self._tables = None

    def __getstate__(self):
        return self.__dict__ | {"_tables": None}

    def _own(self):
        if self._tables is None:
            rng = np.random.default_rng(17)
            axes = rng.standard_normal((len(self.idf), AXES), np.float32) * self.idf[:, None]
            with np.errstate(divide="ignore"):
                races = [(rng.standard_exponential(len(self.idf)) + 1e-9) / self.idf.astype(np.float64) ** 2 for _ in range(2)]
            self._tables = axes, races, np.zeros(len(self.idf), np.int64)
        return self._tables

    def vectors(self, tails: list[np.ndarray]) -> np.ndarray:
        axes, _, last = self._own()
        out = np.zeros((len(tails), AXES), np.float32)
        for i, t in enumerate(tails):
            order = np.arange(len(t))
            last[t] = order
            out[i] = axes[t[last[t] == order]].sum(0)
        return out / (np.linalg.norm(out, axis=1, keepdims=True) + 1e-9)

    def learn(self, sample: np.ndarray, cells: int, rounds: int = 8) -> None:
        """Spherical k-means; cells are numbered along the sample's main axis."""
        centers = sample[np.linspace(0, len(sample) - 1, cells).astype(np.int64)].copy()
        for _ in range(rounds):
            near = (sample @ centers.T).argmax(1)
            sums = np.zeros_like(centers)
            np.add.at(sums, near, sample)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            centers = np.where(norm > 0, sums / np.maximum(norm, 1e-9), centers)
        main = np.linalg.eigh(sample.T @ sample)[1][:, -1]
        self.centers = centers[np.argsort(centers @ main, kind="stable")]

    def places(self, tails: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        """Cell (8 bits), two terms (16 bits each), row hash (20 bits)."""
        _, races, _ = self._own()
        out = (self.vectors(tails) @ self.centers.T).argmax(1).astype(np.int64)
        for race in races:
            out = out << 16 | np.array([int(t[race[t].argmin()]) & 0xFFFF if len(t) else 0 for t in tails], np.int64)
        return out << 20 | (row_hash(rows) >> np.uint64(44)).astype(np.int64)

    def shards(self, tails: list[np.ndarray], rows: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.cuts, self.places(tails, rows), side="right")


def row_hash(rows: np.ndarray) -> np.ndarray:
    return rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def tails_of(b: pa.RecordBatch | pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(t, f"<u{w}") for t, w in zip(b.column("tail").to_pylist(), b.column("width").to_pylist(), strict=True)]


def statistics_of(rows: DataFrame) -> tuple[int, Statistics]:
    """The number of rows, and the statistics of their tails; what reaches the driver has a row for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, last = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        n_rows = n = total = 0
        for b in batches:
            n_rows += b.num_rows
            for t in tails_of(b):
                if len(t):
                    if (top := int(t.max())) >= len(df):
                        df, last = (np.concatenate((x, np.zeros(top + 1 - len(x), np.int64))) for x in (df, last))
                    order = np.arange(len(t))
                    last[t] = order
                    df[t[last[t] == order]] += 1
                    n, total = n + 1, total + len(t)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(([-3, -2, -1], held))), pa.array(np.concatenate(([n_rows, n, total], df[held])))], ["term", "df"])

    found = dict(map(tuple, rows.select("tail", "width").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df")).collect()))
    n_rows, n, total = (found.pop(k, 0) for k in (-3, -2, -1))
    df = np.zeros(max(found, default=0) + 1, np.int64)
    df[list(found)] = list(found.values())
    return n_rows, Statistics(n, total, df)


def learned_deal(rows: DataFrame, n_rows: int, statistics: Statistics, shards: int) -> Deal:
    """Cells from at most about CELL_SAMPLE tails, and cuts from about CUT_SAMPLE places for each shard; both only say where tails meet."""
    deal, context = Deal(statistics), rows.sparkSession.sparkContext
    if shards == 1:
        return deal

    def sampled(target: int, column: str, kind: str, of) -> list:
        held, share = context.broadcast(deal), int((1 << 31) * min(1.0, target / n_rows))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array(of(held.value, tails_of(b), b.column("row").to_numpy()))], [column])

        picked = rows.filter(F.pmod(F.xxhash64("row"), F.lit(1 << 31)) < share).select("row", "tail", "width")
        return [r[0] for r in picked.mapInArrow(run, f"{column} {kind}").collect()]

    vectors = sampled(CELL_SAMPLE, "vector", "binary", lambda d, tails, _: [v.tobytes() for v in d.vectors(tails)])
    if vectors:
        sample = np.frombuffer(b"".join(map(bytes, sorted(vectors))), np.float32).reshape(-1, AXES)
        deal.learn(sample, min(CELLS, shards, len(sample)))
    places = np.sort(np.array(sampled(CUT_SAMPLE * shards, "place", "long", lambda d, tails, at: d.places(tails, at)), np.int64))
    if len(places):
        deal.cuts = places[np.arange(1, shards) * len(places) // shards]
    return deal


def pack_shard(tails: list[np.ndarray], window: int = WINDOW, statistics: Statistics | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start in its tail, length); every id of every tail lies in exactly one."""
    waiting = [i for i, t in enumerate(tails) if len(t)]
    if not waiting:
        return
    docs = [tails[i] for i in waiting]
    index = Bm25Index(docs, statistics)
    at, rest = [0] * len(docs), np.array([len(d) for d in docs])
    left, first = len(docs), 0
    while left:
        while not rest[first]:
            first += 1
        room, pieces = window, []

        def place(d: int, n: int):
            nonlocal room, left
            pieces.append((waiting[d], at[d], n))
            at[d] += n
            rest[d] -= n
            room -= n
            left -= not rest[d]

        seed = first
        place(seed, min(room, int(rest[seed])))
        if room and left:
            near = index.search(docs[seed])
            near = near[rest[near] > 0]
            sizes, k, best = rest[near], 0, None  # best: the first of the neighbours that don't fit whole
            while room >= window // 16 and len(fits := np.flatnonzero(sizes[k:] <= room)):
                j = k + int(fits[0])
                if best is None and j > k:
                    best = int(near[k])
                place(int(near[j]), int(sizes[j]))
                k = j + 1
            if best is None and k < len(near):
                best = int(near[k])
            if room and best is not None:
                place(best, min(room, int(rest[best])))
            d = first
            while room and left:
                while not rest[d]:
                    d += 1
                place(d, min(room, int(rest[d])))
        yield pieces


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end_id: int = END_ID, shard_docs: int = SHARD_DOCS, split_words: bool = True) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. `tokenizer` is the path of a definition file which
    the driver reads; tasks get its content."""
    with open(tokenizer, encoding="utf-8") as f:
        definition = docs.sparkSession.sparkContext.broadcast(f.read())
    id_type = docs.schema[doc_id].dataType.simpleString()

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = WordTokenizer(definition.value, split_words, end_id)
        row = TaskContext.get().partitionId() << 33
        for b in slices(batches, text, rows=1024):
            all_ids = own(byte_list(b, text))
            whole = [len(i) // window * window for i in all_ids]
            rows = np.arange(row, row + b.num_rows)
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([
                pa.array(rows), b.column(doc_id), pa.array([len(i) for i in all_ids], pa.int64()),
                pa.array([[crc_of(i[s : s + window]) for s in range(0, w, window)] for i, w in zip(all_ids, whole, strict=True)], pa.list_(pa.int64())),
                pa.array([i[w:].tobytes() for i, w in zip(all_ids, whole, strict=True)], pa.binary()),
                pa.array([own.dtype.itemsize] * b.num_rows, pa.int32()),
            ], ["row", doc_id, "n", "whole", "tail", "width"])

    def shard_pieces(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [(doc_id, "ascending"), ("row", "ascending")])).combine_chunks()
        number = group.column("shard")[0].as_py() << 32
        out, n = [], group.column("n").to_pylist()
        for i, whole in enumerate(group.column("whole").to_pylist()):
            for k, crc in enumerate(whole):
                out.append((i, k * window, window, crc, number, 0))
                number += 1
        tails = tails_of(group)
        for pieces in pack_shard(tails, window, shared.value):
            offset = 0
            for i, s, length in pieces:
                out.append((i, n[i] - len(tails[i]) + s, length, crc_of(tails[i][s : s + length]), number, offset))
                offset += length
            number += 1
        own, start, length, crc, seq, offset = (pa.array(c, pa.int64()) for c in zip(*out, strict=True))
        columns = [group.column(doc_id).take(own), start, length, crc, group.column("n").take(own), seq, offset]
        return pa.Table.from_arrays(columns, [doc_id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    rows = written(docs.select(doc_id, text).mapInArrow(tokenise, f"row long, {doc_id} {id_type}, n long, whole array<long>, tail binary, width int"), "packing-tails")
    n_rows, statistics = statistics_of(rows)
    shared = docs.sparkSession.sparkContext.broadcast(statistics)
    held = docs.sparkSession.sparkContext.broadcast(learned_deal(rows, n_rows, statistics, max(1, -(-n_rows // shard_docs))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = held.value.shards(tails_of(b), b.column("row").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int64)), *b.columns], ["shard", *b.schema.names])

    dealt = rows.mapInArrow(deal, f"shard long, row long, {doc_id} {id_type}, n long, whole array<long>, tail binary, width int")
    schema = f"{doc_id} {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInArrow(shard_pieces, schema)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer or default_tokenizer())


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """sequences, tokens and padding tokens; a sequence whose length is a power of two isn't padded."""
    lengths = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    power = F.bit_count(F.col("n")) == 1
    return lengths.agg(F.count(F.lit(1)).alias("sequences"), F.sum("n").alias("tokens"), F.sum(F.when(power, 0).otherwise(window - F.col("n"))).alias("padding"))
