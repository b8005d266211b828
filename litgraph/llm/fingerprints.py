"""Fingerprints of documents by one-permutation MinHash, and how like they are to an edited text's and to the next document's.

A text's shingles of five words (A-Z in lower case) are hashed once. The hash's high bits name a bin, and each bin keeps its least hash.
An empty bin takes the value of another: a fixed random sequence of bins belongs to each bin, and the first one of it that holds a shingle
lends its value (optimal densification: lenders are independent of each other, so estimates vary least). Of each bin the low bits are
kept and packed. Two different minima agree in b bits with probability 2**-b, so with a share m of equal bins the estimated similarity is
(m - 2**-b) / (1 - 2**-b), not below 0.

The edited text needs the beginning of the next document in descending order of ids. Texts are compressed, dealt by range and sorted, so they
move once, and a task streams its range with one document pending. What crosses a range is settled from the first and last text of each, which the
first pass writes beside its results; these meet by range number, and only range numbers come to the driver.

Edge cases: null texts are empty. A text of fewer words than a shingle is one shingle, a text without words has none: its fingerprint is
all zeros after a first byte that no other has, it is as like as can be (1) to another such text and unlike (0) any other. Rows that repeat
an id follow each other in order of a hash of their texts; null ids come last. A lone document is its own next one; no documents make no
rows. Very long texts are hashed in parts. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_list, mix, slices, table, token_lists, written

WORDS, BINS, LOW_BITS = 5, 512, 4
U = np.uint64
STEP = U(0x9E3779B97F4A7C15)


class Fingerprinter:
    """Fingerprints of UTF-8 texts: one byte that says whether there are shingles, then the packed bins."""

    def __init__(self, words: int = WORDS, bins: int = BINS, low_bits: int = LOW_BITS, most: int = 100_000) -> None:
        if bins & (bins - 1) or bins < 8 or low_bits not in (1, 2, 4, 8):
            raise ValueError("bins is a power of two of at least 8, low_bits 1, 2, 4 or 8")
        self.words, self.bins, self.low_bits, self.most = words, bins, low_bits, most
        self.shift, self.cache, self.tries = U(64 - bins.bit_length() + 1), {}, {}

    def lenders(self, tries: range) -> np.ndarray:
        """For each bin the bins of these tries."""
        if tries not in self.tries:
            at = np.arange(self.bins, dtype=U)[:, None] * U(0xD1B54A32D192ED03) + np.arange(tries.start, tries.stop, dtype=U) * STEP
            self.tries[tries] = (mix(mix(at + U(0x632BE59BD9B4E019))) >> self.shift).astype(np.int64)
        return self.tries[tries]

    def densified(self, least: np.ndarray, empty: np.ndarray) -> np.ndarray:
        """Every empty bin with the value of its first lender that isn't empty. One bin at least holds a shingle."""
        out, left, begin, n = least.copy(), np.flatnonzero(empty), 0, 16
        while len(left):
            lender = self.lenders(range(begin, begin + n))[left]
            full = ~empty[lender]
            found = full.any(axis=1)
            out[left[found]] = least[lender[found, full[found].argmax(axis=1)]]
            left, begin, n = left[~found], begin + n, min(2 * n, 1024)
            if begin > 1 << 16:  # so many misses have no likelihood worth naming; a lender for sure
                out[left] = least[np.flatnonzero(~empty)[0]]
                break
        return out

    def hashes(self, data: bytes | None) -> Iterator[np.ndarray]:
        """Shingle hashes, by parts of the text; a part begins with the words that the last one's shingles lacked."""
        cache, carried, seen = self.cache, np.zeros(0, U), False
        for tokens in token_lists(data):
            if len(cache) > self.most:
                cache.clear()
            for t in tokens:
                if t not in cache:
                    cache[t] = xxhash.xxh3_64_intdigest(t)
            w = np.concatenate([carried, np.fromiter(map(cache.__getitem__, tokens), U, len(tokens))])
            if len(w) >= self.words:
                yield self.joined(w, self.words)
                seen, carried = True, w[len(w) - self.words + 1 :]
            else:
                carried = w
        if not seen and len(carried):
            yield self.joined(carried, len(carried))

    @staticmethod
    def joined(w: np.ndarray, width: int) -> np.ndarray:
        h = np.full(len(w) - width + 1, width, U)
        for j in range(width):
            h = mix(h + w[j : len(w) - width + 1 + j] + STEP)
        return h

    def __call__(self, data: bytes | None) -> bytes:
        least, empty = np.full(self.bins, ~U(0)), np.ones(self.bins, bool)
        for h in self.hashes(data):
            at = (h >> self.shift).astype(np.int64)
            np.minimum.at(least, at, h)
            empty[at] = False
        if empty.all():
            return bytes(1 + self.bins * self.low_bits // 8)
        low = (mix(self.densified(least, empty)) & U((1 << self.low_bits) - 1)).astype(np.uint8)
        bits = np.unpackbits(low[:, None], axis=1, bitorder="little")[:, : self.low_bits]
        return b"\x01" + np.packbits(bits, bitorder="little").tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        """The estimated Jaccard similarity of the shingle sets of two fingerprints."""
        if a[0] != b[0]:
            return 0.0
        if a == b:
            return 1.0
        other = np.frombuffer(a, np.uint8, offset=1) ^ np.frombuffer(b, np.uint8, offset=1)
        unlike = np.unpackbits(other).reshape(self.bins, self.low_bits).any(axis=1)
        chance = 2.0**-self.low_bits
        return max(0.0, (1 - float(unlike.mean()) - chance) / (1 - chance))


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the beginning of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n]


RESULT = "doc_id {id}, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
COLUMNS = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(make: Fingerprinter, text: str, own: bytes, following: str, following_print: bytes) -> tuple:
    data = edited(text, following).encode()
    new = make(data)
    return len(text), hashlib.sha256(data).hexdigest(), own, new, make.likeness(own, new), make.likeness(own, following_print)


def fingerprint_documents(documents: DataFrame, words: int = WORDS, bins: int = BINS, low_bits: int = LOW_BITS) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row; fingerprints in hexadecimal."""
    Fingerprinter(words, bins, low_bits)
    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.col("tie")]

    def pack(batches):
        zstd = zstandard.ZstdCompressor(level=3, write_content_size=True)
        for piece in slices(batches, "text"):
            data = pa.array([zstd.compress(t) for t in byte_list(piece, "text")], pa.binary())
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), data], ["doc_id", "tie", "text"])

    packed = rows.select("doc_id", "tie", "text").mapInArrow(pack, f"doc_id {kind}, tie long, text binary")
    dealt = packed.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    schema = RESULT.format(id=kind) + ", range int, first_text string, last_text string"

    def stream(batches):
        make, number, zstd = Fingerprinter(words, bins, low_bits), TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        first = pending = None

        def batch(ids, found, range_=None, head=None, tail=None):
            columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64()))]
            ends = [pa.array([v] * len(found), t) for v, t in ((range_, pa.int32()), (head, pa.string()), (tail, pa.string()))]
            return pa.RecordBatch.from_arrays([ids, *columns, *ends], ["doc_id", *COLUMNS, "range", "first_text", "last_text"])

        for piece in slices(batches, "text"):
            ids, found, at = piece.column(0), [], 0
            waiting = pending[0] if pending else ids.slice(0, 0)
            for text in piece.column(1):
                data = zstd.decompress(text.as_py())
                text, own = data.decode(), make(data)
                if pending:
                    found.append(_compared(make, *pending[1:], text, own))
                else:
                    first = text
                pending = (ids.slice(at, 1), text, own)
                at += 1
            if found:
                yield batch(pa.concat_arrays([waiting, ids.slice(0, len(ids) - 1)]), found)
        if pending:
            ids, text, own = pending
            yield batch(ids, [(len(text), None, own, None, None, None)], number, first, text)

    done = written(dealt.mapInArrow(stream, schema), "fingerprints")
    ends = done.filter("range is not null")
    numbers = sorted(r.range for r in ends.select("range").collect())  # one number for each range
    after = documents.sparkSession.createDataFrame(list(zip(numbers, numbers[1:] + numbers[:1])), "range int, following int")
    heads = ends.select(F.col("range").alias("following"), F.col("first_text").alias("following_text"))
    met = ends.join(F.broadcast(after), "range").join(heads, "following").select("doc_id", "last_text", "following_text")

    def close(frames):
        make = Fingerprinter(words, bins, low_bits)
        for part in frames:
            found = [_compared(make, t, make(t.encode()), f, make(f.encode())) for t, f in zip(part["last_text"], part["following_text"])]
            yield pd.concat([part[["doc_id"]].reset_index(drop=True), pd.DataFrame(found, columns=COLUMNS)], axis=1)

    whole = done.filter("range is null").select("doc_id", *COLUMNS).unionByName(met.mapInPandas(close, RESULT.format(id=kind)))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents"))
