"""Removal of long repeated byte strings by bucket-pointer refinement of suffixes.

A string of WIDTH bytes that occurs twice has the same anchor in both places: its q-gram of least hash, the leftmost of them. So suffixes
are dealt by their anchor, and equal ones meet. Consecutive starts with one anchor form a context, the bytes that their strings cover;
a document has about one for each 185 bytes, with a fingerprint.

1. Anchors that occur once end here. A context that occurs twice, by anchor and fingerprint, repeats as a whole.
2. Different contexts of one anchor are compared byte by byte. One of each kind goes to a bin with others; a bin's suffixes are put into
   buckets by their first eight bytes, and buckets are refined by sorting on the bucket identifiers of later offsets, each round reusing
   the last one's, until they stand for WIDTH bytes. Suffixes that are alone in their bucket drop out of every later round.
3. An anchor with more than HOT contexts (a passage in very many documents) is no bin's: its strings' 128-bit fingerprints are counted
   by a partial aggregate instead, which any number of equal strings leaves at one row for each task.

Edge cases: null and empty texts have no bytes and keep none; texts shorter than WIDTH lose nothing; rows that repeat id and text repeat
each other; matches neither cross documents nor depend on what is removed elsewhere; runs of one period repeat themselves; documents of
any length are cut at PIECE bytes with an overlap, which changes no match.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, byte_list, drop, mix, slices, table, written

WIDTH = 400
Q = 32
HOT = 3000
BIN = 1500
PIECE = 4 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each Q bytes, by doubling."""
    h = mix(data.astype(U) + U(0x1234567))
    size, factor = 1, int(_BASE)
    while size < Q:
        h = h[: len(h) - size] * U(factor) + h[size:]
        size, factor = size * 2, factor * factor & (1 << 64) - 1
    return mix(h)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Contexts:
    """Of byte strings: first and last start, anchor, fingerprint."""

    def __init__(self, width: int = WIDTH) -> None:
        self.width, self.up, self.down = width, powers(_BASE, 1024), powers(_INVERSE, 1024)

    def __call__(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for at in range(0, max(len(data) - self.width + 1, 1), PIECE):
            piece = data[at : at + PIECE + self.width - 1]
            if len(piece) >= self.width:
                first, last, g, c = self._piece(np.frombuffer(piece, np.uint8))
                parts.append((first + at, last + at, g, c))
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, U)
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))

    def _piece(self, data: np.ndarray):
        g = gram_hashes(data)
        span = self.width - Q + 1
        n = len(g) - span + 1
        keyed = (g & ~U((1 << 24) - 1)) | np.arange(len(g), dtype=U)
        # Sliding minimum: of the rest of a block of `span` and the beginning of the next one.
        padded = np.concatenate([keyed, np.full(-len(keyed) % span, ~U(0), U)]).reshape(-1, span)
        ahead = np.minimum.accumulate(padded, 1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
        anchor = np.minimum(behind[:n], ahead[span - 1 : span - 1 + n]) & U((1 << 24) - 1)
        first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        last = np.concatenate((first[1:], [n])) - 1
        if len(g) > len(self.up):
            self.up, self.down = powers(_BASE, 2 * len(g)), powers(_INVERSE, 2 * len(g))
        sums = np.concatenate((np.zeros(1, U), np.cumsum(mix(g + U(77)) * self.up[: len(g)], dtype=U)))
        end = last + span
        c = mix((sums[end] - sums[first]) * self.down[first] + (end - first).astype(U))
        return first, last, g[anchor[first].astype(np.int64)], c


def refined_repeats(strings: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each string the starts of those `width` bytes that also start elsewhere in any of the strings."""
    lengths = np.array([len(s) for s in strings])
    data = np.frombuffer(b"".join(strings) + b"\0" * 8, np.uint8)
    ends = np.repeat(np.cumsum(lengths), lengths)
    room = ends - np.arange(len(ends))  # bytes up to the end of the own string
    q = min(8, width)
    codes = np.zeros(len(ends), U)
    for j in range(q):
        codes = codes << U(8) | data[j : j + len(ends)].astype(U)
    pointer = np.full(len(ends), -1, np.int64)  # bucket of each suffix; -1: alone or too short
    alive = np.flatnonzero(room >= q)
    bucket, count = np.unique(codes[alive], return_inverse=True, return_counts=True)[1:]
    alive, bucket = alive[count[bucket] > 1], bucket[count[bucket] > 1]
    pointer[alive] = bucket
    depth = q
    while depth < width and len(alive):
        step = min(depth, width - depth)
        fits = room[alive] >= depth + step
        pointer_later = np.full(len(alive), -1, np.int64)
        pointer_later[fits] = pointer[alive[fits] + step]
        both = pointer_later >= 0
        pointer[alive[~both]] = -1
        alive, later = alive[both], pointer_later[both]
        depth += step
        if not len(alive):
            break
        pair = pointer[alive] * (pointer.max() + 1) + later
        bucket, count = np.unique(pair, return_inverse=True, return_counts=True)[1:]
        keep = count[bucket] > 1
        pointer[alive[~keep]] = -1
        alive = alive[keep]
        pointer[alive] = bucket[keep]
    starts = np.cumsum(lengths) - lengths
    owner = np.searchsorted(starts, alive, side="right") - 1
    cuts = np.searchsorted(owner, np.arange(len(strings) + 1))
    return [alive[cuts[i] : cuts[i + 1]] - starts[i] for i in range(len(strings))]


def runs(starts: np.ndarray) -> list[int]:
    """[first, last, first, last, ...] of consecutive numbers."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) != 1)
    return np.stack([starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))]], 1).ravel().tolist()


def context_rows(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_hash, n_bytes, whole (sha256 of the text) and, for each context, parallel arrays first, last, g, c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = Contexts(width)
        for b in slices(batches, "text"):
            rows = []
            for data in byte_list(b, "text"):
                data = data or b""
                first, last, g, c = contexts(data)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), first, last, g.view(np.int64), c.view(np.int64)))
            types = [pa.int64(), pa.string(), *[pa.list_(pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True))], ["doc_id", "text_hash", "n_bytes", "whole", "first", "last", "g", "c"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, text_hash long, n_bytes long, whole string, first array<long>, last array<long>, g array<long>, c array<long>")


def only_hashes(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """A superset of the rows whose text_hash is in `hashes`; see `Bits`."""
    bits = Bits.of(hashes, "text_hash")
    if bits is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(held.value.holds(b.column("text_hash").to_numpy(zero_copy_only=False))))

    return docs.mapInArrow(run, docs.schema)


def window_prints(reps: DataFrame, width: int) -> DataFrame:
    """g, c, start, w1, w2 (fingerprint of the width bytes at start) for every string of the contexts. Bucket pointers need the buckets of
    later offsets in the same place, or a join of all suffixes for each doubling; the suffixes of one hot anchor fit no task, and six
    joins move eight times what one count of fingerprints does."""

    def run(batches):
        down_q = powers(_INVERSE, 4096)
        up_q = powers(_BASE, 4096)
        for b in batches:
            for g, c, data in zip(b.column("g").to_pylist(), b.column("c").to_pylist(), b.column("content").to_pylist(), strict=True):
                h = gram_hashes(np.frombuffer(data, np.uint8))
                span = width - Q + 1
                n = len(h) - span + 1
                prints = []
                for salt in (U(5), U(6)):
                    s = np.concatenate((np.zeros(1, U), np.cumsum(mix(h + salt) * up_q[: len(h)], dtype=U)))
                    prints.append(mix((s[span:] - s[:n]) * down_q[:n]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([g] * n, pa.int64()), pa.array([c] * n, pa.int64()), pa.array(np.arange(n)), *map(pa.array, prints)], ["g", "c", "start", "w1", "w2"])

    return reps.select("g", "c", "content").mapInArrow(run, "g long, c long, start long, w1 long, w2 long")


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    docs = docs.withColumn("text_hash", F.xxhash64("text", F.lit(width)))
    rows = written(context_rows(docs, width), "suffix-contexts")
    one = F.explode(F.arrays_zip("first", "last", "g", "c")).alias("x")
    flat = rows.select("doc_id", "text_hash", one).select("doc_id", "text_hash", "x.first", "x.last", "x.g", "x.c")
    # Aggregates that go back to their rows are tables first: a join with a table can be split where an anchor has many rows.
    anchors = flat.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).filter("n > 1")
    anchors = written(anchors.select("g", (F.col("low") != F.col("high")).alias("mixed")), "suffix-anchors")
    shared = written(flat.join(anchors, "g"), "suffix-shared")
    drop(anchors)
    kinds = written(shared.filter("mixed").groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("text_hash", "first", "last")).alias("at")), "suffix-kinds")
    per_anchor = written(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")), "suffix-kinds-of")
    wanted = kinds.join(per_anchor, "g").select("g", "c", "n", "kinds", "at.*")
    texts = written(only_hashes(docs.select("text_hash", "text"), kinds.select("at.text_hash")).dropDuplicates(["text_hash"]), "suffix-texts")
    content = F.substring(F.col("text").cast("binary"), F.col("first").cast("int") + 1, (F.col("last") - F.col("first")).cast("int") + width)
    reps = written(wanted.join(texts, "text_hash").select("g", "c", "n", "kinds", content.alias("content")), "suffix-reps")
    bins = max(1, reps.filter(F.col("kinds") <= HOT).count() // BIN)

    def refine(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["g", "c"])
        found = refined_repeats(part["content"].tolist(), width)
        return pd.DataFrame({"g": part["g"], "c": part["c"], "parts": [runs(f) for f in found]})

    cold = reps.filter(F.col("kinds") <= HOT).groupBy(F.pmod(F.xxhash64("g"), F.lit(bins))).applyInPandas(refine, "g long, c long, parts array<long>")
    prints = window_prints(reps.filter(F.col("kinds") > HOT), width)
    again = prints.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("w1", "w2")
    hot = prints.join(again, ["w1", "w2"]).groupBy("g", "c").agg(F.sort_array(F.collect_list("start")).alias("starts"))  # at most one row for each of a context's starts
    hot = hot.select("g", "c", F.flatten(F.transform("starts", lambda s: F.array(s, s))).alias("parts"))
    parts = cold.unionByName(hot).filter(F.size("parts") > 0)
    pieces = F.transform(F.sequence(F.lit(0), F.expr("size(parts) DIV 2 - 1")), lambda i: F.struct((F.col("first") + F.get("parts", i * 2)).alias("first"), (F.col("first") + F.get("parts", i * 2 + 1)).alias("last")))
    own = F.array(F.struct("first", "last"))
    whole = shared.filter(~F.col("mixed")).select("doc_id", "text_hash", own.alias("parts"))
    repeated = shared.filter("mixed").join(kinds.filter("n > 1").select("g", "c"), ["g", "c"], "left_semi").select("doc_id", "text_hash", own.alias("parts"))
    partly = shared.filter("mixed").join(parts, ["g", "c"]).select("doc_id", "text_hash", pieces.alias("parts"))
    spans = written(whole.unionByName(repeated).unionByName(partly).groupBy(F.col("text_hash").alias("h"), F.col("doc_id").alias("i")).agg(F.flatten(F.collect_set("parts")).alias("spans")), "suffix-spans")

    def cut(batches):
        for b in slices(batches, "text"):
            out = []
            for data, spans_of in zip(byte_list(b, "text"), b.column("spans").to_pylist(), strict=True):
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, [s["first"] for s in spans_of], 1)
                np.add.at(edge, [s["last"] + width for s in spans_of], -1)
                gone = np.cumsum(edge)[:-1] > 0
                kept = np.frombuffer(data, np.uint8)[~gone]
                out.append((int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept.tobytes()).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("i"), b.column("h"), *(pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int64(), pa.int64(), pa.string()), strict=True))], ["i", "h", "n_removed", "n_spans", "kept"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    touched = only_hashes(docs, spans.select(F.col("h").alias("text_hash"))).dropDuplicates(["doc_id", "text_hash"])
    same = (F.col("text_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("i"))
    less = touched.join(spans, same).select("i", "h", "text", "spans").mapInArrow(cut, f"i {id_type}, h long, n_removed long, n_spans long, kept string")
    result = rows.select("doc_id", "text_hash", "n_bytes", "whole").join(less, same, "left")
    return result.select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("n_spans", F.lit(0)).cast("long").alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))




OP8_SQL = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i - 1, 800)) AS m FROM (SELECT r, h, unnest(range(1, n - 400 + 2)) AS i FROM d WHERE n >= 400)),
s AS (SELECT r, i FROM w WHERE m IN (SELECT m FROM w GROUP BY m HAVING count(*) > 1)),
g AS (SELECT r, i, sum(CAST(gap AS INT)) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 400, true) AS gap FROM s)),
p AS (SELECT r, min(i) AS a, max(i) + 399 AS b FROM g GROUP BY r, k),
q AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM p),
x AS (SELECT r, count(*) AS n_spans, sum(b - a + 1) AS n_removed, max(b) AS last, string_agg(substr(h, 2 * before + 1, 2 * (a - before - 1)), '' ORDER BY a) AS head FROM q JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN x USING (r)
"""
