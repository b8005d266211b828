"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton holds every substring of every item. A document's words stream through it; at each word it knows the length of the
longest suffix that is a substring of some item. Where that length reaches the window size, the window's last word is found, and the
window's items are read off the automaton's states. The automaton is broadcast in blocks of at most `block_words` item words, so its
size is bounded however large the benchmark is: a benchmark beyond one block takes one pass for each block, and the passes add up.

Edge cases: null or wordless texts have no words and no hits; items without words match nothing; repeated items count once for each
item_id; items without an id match like others and count as one id, which items_sha256 leaves out; repeated documents are handled row by row; an empty benchmark hits nothing; an item longer than a block is cut in pieces
which overlap by one window less a word, so that no window is lost. Extra columns pass through; the columns that the operator adds
replace columns of the same name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import byte_list, table, words_of, written

WINDOW = 10
BLOCK_WORDS = 200_000
HASH = 1 << 20
ADDED = {"n_words": T.LongType(), "hit_spans": T.ArrayType(T.IntegerType()), "hit_items": T.ArrayType(T.LongType())}


class SuffixAutomaton:
    """Of several word sequences. State 0 is the root; a state's strings end at the same places, the longest has `length` words."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The part of q's strings which are no longer than p's longest with the word gets a state of its own."""
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = c
            p = self.link[p]
        return c

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            q = self.next[last].get(w)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
                continue
            new, p = self._state(self.length[last] + 1, {}, 0), last
            while p != -1 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p != -1:
                q = self.next[p][w]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
            last = new


class Matcher:
    """Finds the windows of a block of items in word lists."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        number = lambda words: [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
        coded = [(i, number(words)) for i, words in items if words]
        a = self.automaton = SuffixAutomaton()
        for _, words in coded:
            a.add(words)
        long_items: dict[int, set[int]] = {}
        short_items: dict[int, dict[int, set[int]]] = {}
        self.least = min((min(window, len(words)) for _, words in coded), default=window)
        for i, words in coded:
            v = 0
            for k, w in enumerate(words, 1):
                v = a.next[v][w]
                if k >= window:
                    u = v
                    while a.length[a.link[u]] >= window:
                        u = a.link[u]
                    long_items.setdefault(u, set()).add(i)
            if len(words) < window:
                while a.length[a.link[v]] >= len(words):
                    v = a.link[v]
                short_items.setdefault(v, {}).setdefault(len(words), set()).add(i)
        n = len(a.link)
        order = sorted(range(n), key=a.length.__getitem__)
        #: For each state, its ancestor (itself included) whose strings have window words, or -1.
        self.full = [-1] * n
        #: For each state, the short items that are suffixes of its strings: (words, items), shorter ones first.
        self.short: list[tuple] = [()] * n
        for v in order:
            up = a.link[v]
            if a.length[v] >= window:
                self.full[v] = v if up < 0 or a.length[up] < window else self.full[up]
            self.short[v] = (self.short[up] if up > 0 else ()) + tuple(sorted((m, tuple(s)) for m, s in short_items.get(v, {}).items()))
        self.items = {v: tuple(s) for v, s in long_items.items()}
        pairs = np.zeros(HASH, bool)
        for _, words in coded:
            w = np.asarray(words, np.int64)
            pairs[(w[:-1] * 40_503 + w[1:]) & (HASH - 1)] = True
        self.pairs = pairs

    def spans(self, words: list[bytes]) -> tuple[list[int], set[int]]:
        """Word spans [start, end, start, end, ...] covered by windows, merged and in order, and the items of these windows."""
        n = len(words)
        if n < self.least or not self.vocabulary:
            return [], set()
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.int64, n)
        known = ids > 0
        if not known.any():
            return [], set()
        # Only runs of words whose neighbouring pairs occur in an item can hold a window; elsewhere the match is shorter than two words.
        joined = known[:-1] & known[1:] & self.pairs[(ids[:-1] * 40_503 + ids[1:]) & (HASH - 1)]
        edge = np.diff(np.concatenate(([0], joined.view(np.int8), [0])))
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        if self.least == 1:
            alone = np.flatnonzero(known & ~np.concatenate((joined, [False])) & ~np.concatenate(([False], joined)))
            begins, ends = np.sort(np.concatenate((begins, alone))), np.sort(np.concatenate((ends, alone + 1)))
        keep = ends - begins >= self.least
        out: list[int] = []
        items: set[int] = set()
        for s, e in zip(begins[keep].tolist(), ends[keep].tolist(), strict=True):
            self._run(ids[s:e].tolist(), s, out, items)
        return out, items

    def _run(self, ids: list[int], base: int, out: list[int], items: set[int]) -> None:
        a, window = self.automaton, self.window
        step, link, length, full, short = a.next, a.link, a.length, self.full, self.short
        v = matched = 0
        for i, w in enumerate(ids, base + 1):
            while v and w not in step[v]:
                v = link[v]
                matched = length[v]
            u = step[v].get(w)
            if u is None:
                continue
            v, matched = u, matched + 1
            reach = 0
            if matched >= window:
                reach = window
                items.update(self.items.get(full[v], ()))
            for m, found in short[v]:
                if m <= matched:
                    reach = max(reach, m)
                    items.update(found)
            if reach:
                start = i - reach
                while out and start <= out[-1]:
                    out.pop()
                    start = min(start, out.pop())
                out += (start, i)


def merge_spans(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += (s, e)
    return out


def item_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Items in blocks of about block_words words; rows come to the driver one partition after another."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).cast("binary").alias("t")).filter("t is not null").toLocalIterator():
        words = words_of(bytes(row.t))
        step = max(block_words - window + 1, 1)
        pieces = [words] if len(words) <= block_words else [words[k : k + block_words] for k in range(0, len(words) - window + 1, step)]
        for piece in pieces:
            if size and size + len(piece) > block_words:
                yield block
                block, size = [], 0
            block.append((row.i, piece))
            size += len(piece)
    yield block


def match_benchmark(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, hit_spans (word offsets start, end, start, end, ...; merged) and hit_items (sorted ids, null last) added."""
    docs = docs.drop(*ADDED)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(k, v) for k, v in ADDED.items())])
    spark, out, first = docs.sparkSession, docs, True
    blocks = item_blocks(items, item_id, item_text, window, block_words)
    for block in blocks:
        if not first:
            out = written(out, "decontaminate")
        matcher = spark.sparkContext.broadcast(Matcher(block, window))
        out = out.mapInArrow(_pass(matcher, text, first, [f.name for f in schema.fields]), schema)
        first = False
    return out


def _pass(matcher, text: str, first: bool, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher.value.spans
        for b in batches:
            n_words, spans, items = [], [], []
            before = [([], [])] * b.num_rows if first else list(zip(b.column("hit_spans").to_pylist(), b.column("hit_items").to_pylist(), strict=True))
            for data, (old_spans, old_items) in zip(byte_list(b, text), before, strict=True):
                words = words_of(data)
                s, i = find(words)
                n_words.append(len(words))
                spans.append(merge_spans(old_spans, s) if old_spans else s)
                items.append(sorted(i.union(old_items), key=lambda x: (x is None, x or 0)))
            kept = [b.column(k) for k in names[: len(names) - len(ADDED)]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.int64()))], names)

    return run


def n_hit(spans: str = "hit_spans") -> Column:
    """Words covered: the ends less the starts of the flat list."""
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def cut_spans(docs: DataFrame, text: str = "text", max_coverage: float = 0.5) -> DataFrame:
    """Documents without the spans found: a hit of a single word or more goes from the text; a document goes as a whole when more than
    max_coverage of its words are hit. The columns of match_benchmark go, too. Null texts and texts without hits stay as they are."""
    names = [c for c in docs.columns if c not in ADDED]
    schema = T.StructType([f for f in docs.schema.fields if f.name not in ADDED])

    def run(batches):
        import re

        word = re.compile(rb"[0-9a-z\x80-\xff]+")
        for b in batches:
            texts = byte_list(b, text)
            for k, spans in enumerate(b.column("hit_spans").to_pylist()):
                if spans:
                    data, at, parts, hits = texts[k], 0, [], iter([*spans, 1 << 62])
                    lowered, edge, inside = data.lower(), next(hits), False
                    end_of_last = 0
                    for i, m in enumerate(word.finditer(lowered)):
                        while i == edge:
                            if inside:
                                at = end_of_last
                            else:
                                parts.append(data[at : m.start()])
                            inside, edge = not inside, next(hits)
                        end_of_last = m.end()
                    parts.append(data[end_of_last if inside else at :])
                    texts[k] = b"".join(parts)
            new = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text else b.column(c) for c in names], names)

    covered = F.coalesce(n_hit() > F.col("n_words") * max_coverage, F.lit(False))
    return docs.filter(~covered).mapInArrow(run, schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    found = match_benchmark(docs.select("doc_id", "text"), items)
    ids = F.array_join(F.sort_array(F.transform("hit_items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit().alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
places AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r),
ids AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (r) LEFT JOIN ids USING (r)
"""
