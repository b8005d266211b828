"""Jaccard join of word-shingle sets: subsets of small sets, inverted lists of large ones.

Documents with equal sets are one: a 128-bit fingerprint of the set groups them. Of two other sets, both *light*, each differs from
their common part by at most a tenth of its elements, so both have that part among their subsets of its size; light sets enumerate
these subsets and meet in one. *Heavy* sets (and the largest light ones, which may link to them) go to inverted lists. An element of a
list is a block of shingles, not a single one: the shingles of a set are dealt by hash to one block more than two linked sets of its
size class can differ in, so linked sets agree on a whole block, and a shingle that every document holds makes no common list. A block
without shingles says nothing, so there are a few blocks to spare, about as many as are empty; sets with more empty ones are dealt again
with another seed, and only the last deal lists empty blocks.
The boundary between light and heavy is the one of least cost on a sample: subsets and list entries to write, and sets to verify.

Lists hold candidates. First every member is compared with the smallest id of its list. Of lists whose members aren't in one component
then, those with the same smallest id make a group: two sets that link share a list, so they share a group. A group of more than two blocks
of BLOCK sets is cut into blocks of similar size, and each pair of blocks whose sizes allow links is one task's piece of work. There,
common shingles of all sets that aren't in the block's largest component with all others are counted at once, as a product of incidence
matrices. Before texts move, sketches of 256 bytes (counts of shingles by hash, whose difference is never more than that of the sets) rule
out most pairs. All counts are exact, and no pair of documents is ever a row, so a group of thousands of near copies costs its members
once for each block beside theirs, and no link between components is lost.

Edge cases: null texts and texts without words have no set, link with nothing and are their own component; a text of fewer words than
a shingle has its whole sequence as the one shingle; rows that repeat an id are one document's and share a component; null ids get a
null component; lists, groups and components are joined and aggregated, never collected.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import OrderedDict
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bits, bounded_sample, byte_list, drop, mix, release, slices, table, tokens_of, written
from .components import connected

VERIFY_COST = 10.0
COST_SAMPLE = 1000
DEALS = 3
BLOCK = 512
U = np.uint64


class Shingler:
    """64-bit hashes of the distinct shingles of a text, sorted."""

    def __init__(self, words: int, most: int = 100_000) -> None:
        self.words, self.most, self.cache = words, most, {}

    def __call__(self, data: bytes | None) -> np.ndarray:
        tokens, cache = tokens_of(data), self.cache
        if len(cache) > self.most:
            cache.clear()
        for t in tokens:
            if t not in cache:
                cache[t] = xxhash.xxh3_64_intdigest(t)
        w = np.fromiter(map(cache.__getitem__, tokens), U, len(tokens))
        if not len(w):
            return w
        width = min(self.words, len(w))
        h = np.full(len(w) - width + 1, width, U)
        for j in range(width):
            h = mix(h + w[j : len(w) - width + 1 + j] + U(0x9E3779B97F4A7C15))
        return np.unique(h)


class Signatures:
    """Keys under which linked sets meet, for a threshold num/den and a boundary: sets of at most `boundary` shingles are light."""

    def __init__(self, num: int, den: int, boundary: int) -> None:
        self.num, self.den, self.boundary = num, den, boundary
        #: First size of each class; sets that link are in one class or in neighbours.
        self.first = [boundary + 1]
        self._spare: dict[int, int] = {}

    def _extend(self) -> None:
        self.first.append(self.first[-1] * self.den // self.num + 1)

    def klass(self, n: int) -> int:
        """-1 for light sets."""
        while self.first[-1] <= n:
            self._extend()
        return bisect_right(self.first, n) - 1

    def blocks(self, k: int) -> int:
        while len(self.first) <= k + 1:
            self._extend()
        largest = self.first[k + 1] - 1
        return 2 * largest * (self.den - self.num) // (self.den + self.num) + 1 + self.spare(k)

    def spare(self, k: int) -> int:
        """Blocks beyond one more than linked sets can differ in. Sets with no more empty blocks than that agree on one with shingles."""
        if k not in self._spare:
            while len(self.first) <= k + 1:
                self._extend()
            least, largest = self.first[k] * self.num / self.den, self.first[k + 1] - 1
            needed, out = 2 * largest * (self.den - self.num) // (self.den + self.num) + 1, 0
            for _ in range(4):
                empty = (needed + out) * np.exp(-least / (needed + out))
                out = 0 if empty < 0.02 else int(np.ceil(empty + 2 * np.sqrt(empty)))
            self._spare[k] = out
        return self._spare[k]

    def missing(self, n: int) -> int:
        """Shingles that a set of n may hold beyond its common part with one it links to."""
        return n * (self.den - self.num) // self.den

    def entries(self, n: int) -> int:
        if n <= self.boundary:
            return sum(comb(n, d) for d in range(self.missing(n) + 1))
        k = self.klass(n)
        return self.blocks(k) + self.blocks(k + 1)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        n, out = len(h), []
        k = self.klass(n)
        if k < 0:
            out.append(self._subsets(h))
        for t in (k, k + 1):
            if t >= 0 and (t > k or k >= 0) and n * self.den >= self.num * self.first[t]:
                out.append(self._blocks(h, t))
        return np.concatenate(out) if out else np.zeros(0, U)

    def _subsets(self, h: np.ndarray) -> np.ndarray:
        """A subset's key is the sum of its shingles' values, so leaving shingles out is a subtraction."""
        v = mix(h ^ U(0xA5A5A5A5A5A5A5A5))
        sums = [v.sum(dtype=U)[None]]
        last = np.full(1, -1)
        for _ in range(self.missing(len(h))):
            pairs = [(s, i) for s, at in zip(sums[-1], last, strict=True) for i in range(at + 1, len(v))]
            own = np.array([i for _, i in pairs], np.int64)
            sums.append(np.array([s for s, _ in pairs], U) - v[own])
            last = own
        return np.concatenate([mix(s + U((len(h) - d) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) for d, s in enumerate(sums)])

    def _blocks(self, h: np.ndarray, t: int) -> np.ndarray:
        n, out = self.blocks(t), []
        for deal in range(DEALS):
            base = U((t * DEALS + deal + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1)
            block = (mix(h + base) >> U(20)) % U(n)
            sums, sizes = np.zeros(n, U), np.bincount(block.astype(np.int64), minlength=n)
            np.add.at(sums, block.astype(np.int64), mix(h ^ base))
            keys = mix(mix(sums + U(1)) + base + np.arange(n, dtype=U) * U(0x9E3779B97F4A7C15))
            empty = sizes == 0
            out.append(keys if deal == DEALS - 1 else keys[~empty])
            if empty.sum() <= self.spare(t):
                break
        return np.concatenate(out)


def set_sizes(docs: DataFrame, words: int) -> list[int]:
    """Of a bounded sample's texts; they are counted where they lie, and only numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(words)
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([len(shingles(t)) for t in byte_list(b, "text")], pa.int64())], ["n"])

    return [r[0] for r in docs.select("text").mapInArrow(run, "n long").collect()]


def best_boundary(sizes: list[int], num: int, den: int) -> int:
    """Of the sizes at which one more shingle may be missing, and those between, the boundary of least cost for the sampled sizes."""
    limit = 3 * den // (den - num)

    def cost(x: int) -> float:
        s = Signatures(num, den, x)
        return sum(s.entries(n) + (n > x) * VERIFY_COST for n in sizes if n)

    return min(range(1, limit), key=lambda x: (cost(x), x))


def set_rows(docs: DataFrame, doc_id: str, text: str, words: int, signatures: Signatures) -> DataFrame:
    """doc_id, n_shingles, hi, lo (fingerprint), keys and sketch; keys are empty for null ids and for sets that the task has lately seen
    under an id. A sketch counts shingles by hash into 256 groups: two sketches differ by no more than their sets do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, seen = Shingler(words), set()
        for b in slices(batches, text):
            n, hi, lo, keys, sketch = [], [], [], [], []
            for i, data in zip(b.column(doc_id).to_pylist(), byte_list(b, text), strict=True):
                h = shingles(data)
                n.append(len(h))
                digest = xxhash.xxh3_128_intdigest(h.tobytes()) if len(h) else 0
                hi.append((digest >> 64) - (1 << 63))
                lo.append((digest & (1 << 64) - 1) - (1 << 63))
                keys.append(signatures(h).view(np.int64) if len(h) and i is not None and digest not in seen else [])
                sketch.append(np.minimum(np.bincount((mix(h ^ U(0x51ED270B)) >> U(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes())
                if i is not None:
                    if len(seen) > 50_000:
                        seen.clear()
                    seen.add(digest)
            yield pa.RecordBatch.from_arrays([b.column(doc_id).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "hi", "lo", "keys", "sketch"])
        shingles.cache.clear()
        seen.clear()
        release()

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, keys array<long>, sketch binary")


def only_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of a superset of the rows whose id is in `ids`; see `Bits`."""
    bits = Bits.of(ids, "doc_id")
    if bits is None:
        return docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(held.value.holds(b.column("doc_id").to_numpy(zero_copy_only=False))))

    return docs.filter("doc_id is not null and text is not null").select("doc_id", "text").mapInArrow(run, "doc_id long, text string")


def verified(pairs: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        shingles, cache = Shingler(words), OrderedDict()

        def of(data):
            at = xxhash.xxh3_128_digest(data)
            if at not in cache:
                cache[at] = shingles(data)
                if len(cache) > 512:
                    cache.popitem(last=False)
            return cache[at]

        for b in slices(slices(batches, "text_a"), "text_b"):
            out = []
            for i, j, s, t in zip(b.column("a").to_pylist(), b.column("b").to_pylist(), byte_list(b, "text_a"), byte_list(b, "text_b"), strict=True):
                x, y = of(s), of(t)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if den * common >= num * (len(x) + len(y) - common):
                    out.append((i, j))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def entries_of(known: DataFrame, shared: DataFrame) -> DataFrame:
    """(key, doc_id) of a superset of the keys in `shared`; see `Bits`."""
    bits = Bits.of(shared, "key")
    if bits is None:
        return known.select(F.explode("keys").alias("key"), "doc_id")
    held = known.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column("keys")
            flat = keys.flatten().to_numpy(zero_copy_only=False)
            n = pc.list_value_length(keys).to_numpy(zero_copy_only=False)
            keep = held.value.holds(flat)
            owner = np.repeat(b.column("doc_id").to_numpy(zero_copy_only=False), n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(flat[keep], pa.int64()), pa.array(owner[keep], pa.int64())], ["key", "doc_id"])

    return known.filter("size(keys) > 0").select("doc_id", "keys").mapInArrow(run, "key long, doc_id long")


def block_pairs(rest: DataFrame, num: int, den: int) -> DataFrame:
    """A written table: doc_id, component, work, n1 and sketch; a work is what one comparison takes. A group of at most two blocks is one work. A larger
    one is cut into blocks of sets within a twentieth of each other in size, and each pair of blocks whose sizes allow links is a work."""
    rows = rest.select("gid", "doc_id", "component", F.col("set.n1").alias("n1"), F.col("set.n0").alias("n0"), "set.sketch")
    large = written(rows.groupBy("gid").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > 2 * BLOCK).select("gid"), "jaccard-large")
    out = rows.join(large, "gid", "left_anti").select("doc_id", "component", F.col("gid").alias("work"), "n1", "sketch")
    if large.isEmpty():
        out = written(out, "jaccard-blocks")
        drop(large)
        return out
    level = F.floor(F.log(F.col("n0").cast("double")) / F.log(F.lit(1.05))).cast("int")
    rows = rows.join(large, "gid", "left_semi").withColumn("level", level)
    blocks = rows.groupBy("gid", "level").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("count"), F.min("n0").alias("n0"), F.max("n1").alias("n1"))
    blocks = written(blocks, "jaccard-levels")
    dealt = rows.join(blocks.select("gid", "level", "count"), ["gid", "level"]).withColumn("b", F.pmod(F.xxhash64("doc_id"), "count")).select("gid", "doc_id", "component", "level", "b", "n1", "sketch")
    each = blocks.select("gid", "level", "n0", "n1", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("b"))
    x, y = each.alias("x"), each.alias("y")
    ordered = F.struct("x.level", "x.b") <= F.struct("y.level", "y.b")
    pairs = x.join(y, (F.col("x.gid") == F.col("y.gid")) & ordered & (F.least("x.n1", "y.n1") * den >= F.greatest("x.n0", "y.n0") * num))
    work = F.xxhash64("x.gid", "x.level", "x.b", "y.level", "y.b").alias("work")
    sides = F.array_distinct(F.array(F.struct(F.col("x.level").alias("level"), F.col("x.b").alias("b")), F.struct(F.col("y.level").alias("level"), F.col("y.b").alias("b"))))
    parts = pairs.select(F.col("x.gid").alias("gid"), work, F.explode(sides).alias("s")).select("gid", "work", "s.level", "s.b")
    out = written(out.unionByName(dealt.join(parts, ["gid", "level", "b"]).select("doc_id", "component", "work", "n1", "sketch")), "jaccard-blocks")
    for used in (large, blocks):
        drop(used)
    return out


def links_in_block(sets: list[np.ndarray], component: np.ndarray, num: int, den: int) -> list[tuple[int, int]]:
    """Index pairs that link and between them join all components that links of these sets join."""
    labels, own = np.unique(component, return_inverse=True)
    if len(labels) < 2:
        return []
    asked = np.flatnonzero(own != np.bincount(own).argmax())
    sizes = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(len(sets)), sizes)
    _, shingle, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.zeros((len(asked), len(sets)), np.float32)
    place = np.full(len(sets), -1)
    place[asked] = np.arange(len(asked))
    # Frequent shingles as columns of incidence matrices, a few at a time; rare ones pair by pair.
    frequent = np.flatnonzero(df > 24)
    column = np.full(len(df), -1)
    column[frequent] = np.arange(len(frequent))
    for at in range(0, len(frequent), 2048):
        use = np.flatnonzero((column[shingle] >= at) & (column[shingle] < at + 2048))
        m = np.zeros((len(sets), min(2048, len(frequent) - at)), np.float32)
        m[who[use], column[shingle[use]] - at] = 1
        common += m[asked] @ m.T
    rare = np.flatnonzero((df[shingle] > 1) & (df[shingle] <= 24))
    rare = rare[np.argsort(shingle[rare], kind="stable")]
    begin = np.flatnonzero(np.concatenate(([True], np.diff(shingle[rare]) != 0))) if len(rare) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate((begin, [len(rare)]))) if len(rare) else begin
    for d in np.unique(length).tolist():
        rows = who[rare[begin[length == d][:, None] + np.arange(d)]]
        i, j = np.repeat(rows, d, 1).ravel(), np.tile(rows, d).ravel()
        keep = place[i] >= 0
        np.add.at(common, (place[i[keep]], j[keep]), 1)
    common = np.rint(common).astype(np.int64)
    yes = (den * common >= num * (sizes[asked][:, None] + sizes[None, :] - common)) & (own[asked][:, None] != own[None, :])
    out, root = [], list(range(len(labels)))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for i, j in np.argwhere(yes).tolist():
        a, b = find(own[asked[i]]), find(own[j])
        if a != b:
            root[a] = b
            out.append((int(asked[i]), j))
    return out


def differ(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of absolute differences of sketches (uint8), along the last axis."""
    return np.abs(a.astype(np.int16) - b.astype(np.int16)).sum(-1, dtype=np.int64)


def possible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) whose sketches don't rule a link out; linked sets differ in at most (den - num) / (den + num) of both sizes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            known = (part["x"].notna() & part["y"].notna()).to_numpy()
            keep = ~known
            if known.any():
                x, y = (np.frombuffer(b"".join(part.loc[known, c]), np.uint8).reshape(-1, 256) for c in ("x", "y"))
                keep[known] = differ(x, y) * (den + num) <= part.loc[known, "n"].to_numpy() * (den - num)
            yield part.loc[keep, ["a", "b"]]

    sizes = F.col("a_set.n1") + F.col("b_set.n1")
    return pairs.select("a", "b", F.col("a_set.sketch").alias("x"), F.col("b_set.sketch").alias("y"), sizes.alias("n")).mapInPandas(run, "a long, b long")


def sifted(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Rows (doc_id, component, work) of `block_pairs`, a written table, whose sketch leaves a link to another component of the same work
    possible."""
    bins = max(1, rows.count() // (4 * BLOCK))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, one in part.groupby("work", sort=True):
            keep = one["sketch"].isna().to_numpy().copy()
            everything = keep.any()
            own, n = np.unique(one["component"].to_numpy(), return_inverse=True)[1], one["n1"].to_numpy()
            asked = np.flatnonzero(own != np.bincount(own).argmax())
            if everything:
                keep[:] = True
            elif len(asked):
                x = np.frombuffer(b"".join(one["sketch"]), np.uint8).reshape(-1, 256)
                for i in asked.tolist():
                    near = (own != own[i]) & (differ(x, x[i]) * (den + num) <= (n + n[i]) * (den - num))
                    if near.any():
                        keep |= near
                        keep[i] = True
            out.append(one.loc[keep, ["doc_id", "component", "work"]])
        return pd.concat(out)

    kept = written(rows.groupBy(F.pmod("work", F.lit(bins))).applyInPandas(run, "doc_id long, component long, work long"), "jaccard-sifted")
    drop(rows)
    return kept


def verified_blocks(rows: DataFrame, texts: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between different components in each work of rows (doc_id, component, work)."""
    bins = max(1, rows.count() // (4 * BLOCK))

    def run(part):
        shingles, out = Shingler(words), []
        sets_of = {t: shingles(t.encode()) for t in set(part["text"])}
        for _, one in part.groupby("work", sort=True):
            one = one.sort_values("doc_id")
            ids = one["doc_id"].tolist()
            out += [(ids[i], ids[j]) for i, j in links_in_block([sets_of[t] for t in one["text"]], one["component"].to_numpy(), num, den)]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return rows.join(texts, "doc_id").groupBy(F.pmod("work", F.lit(bins))).applyInPandas(run, "a long, b long")


def link_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id for each row; documents link when den * common >= num * union."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    signatures = Signatures(num, den, best_boundary(set_sizes(bounded_sample(docs.filter("text is not null"), "doc_id", COST_SAMPLE), words), num, den))
    sets = written(set_rows(docs, "doc_id", "text", words, signatures), "jaccard-sets")
    known = sets.filter("doc_id is not null and n_shingles > 0")
    # Aggregates that go back to their rows are tables first: a join with a table can be split where a key has many rows.
    # Equal sets: everyone to the smallest id of the set.
    groups = written(known.groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "jaccard-groups")
    equal = written(known.select("doc_id", "hi", "lo").join(groups, ["hi", "lo"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b"), "jaccard-equal")
    drop(groups)
    # Lists: keys that occur once end in the first count, which moves nothing but keys. Of the others, the smallest id is the hub, and
    # every other member makes a row.
    shared = written(known.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key"), "jaccard-shared")
    entries = written(entries_of(known, shared), "jaccard-entries")
    drop(shared)
    hubs = written(entries.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).filter("hub < last").select("key", "hub"), "jaccard-hubs")
    lists = written(entries.join(hubs, "key").filter("doc_id <> hub"), "jaccard-lists")
    drop(hubs)
    drop(entries)
    star = lists.select(F.col("doc_id").alias("a"), F.col("hub").alias("b")).distinct()
    about = known.groupBy("doc_id").agg(F.min("n_shingles").alias("n0"), F.max("n_shingles").alias("n1"), F.min("hi").alias("h0"), F.max("hi").alias("h1"), F.min("sketch").alias("sketch"))
    about = written(about.withColumn("sketch", F.when(F.col("h0") == F.col("h1"), F.col("sketch"))), "jaccard-about")  # texts that share an id have no one sketch
    of = lambda end: about.select(F.col("doc_id").alias(end), F.struct("n0", "n1", "h0", "h1", "sketch").alias(f"{end}_set"))
    fits = lambda x, y: F.least(x["n1"], y["n1"]) * den >= F.greatest(x["n0"], y["n0"]) * num
    same = F.greatest("a_set.h1", "b_set.h1") == F.least("a_set.h0", "b_set.h0")
    first = written(possible(star.join(of("a"), "a").join(of("b"), "b").filter(~same & fits(F.col("a_set"), F.col("b_set"))), num, den), "jaccard-pairs")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("doc_id"))
    texts = written(only_ids(docs, ends(first)), "jaccard-texts")
    links = written(equal.unionByName(verified(first, texts, words, num, den)), "jaccard-links")
    drop(equal)
    labels = written(connected(links), "jaccard-labels")
    # Lists of three and more that still hold several components.
    long = written(lists.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("hub").alias("hub")).filter("n > 1").select("key", "hub"), "jaccard-long")
    rows = lists.join(long.select("key"), "key", "left_semi").select("key", "doc_id", "hub").unionByName(long.select("key", F.col("hub").alias("doc_id"), "hub"))
    named = rows.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    named = written(named.select("key", "doc_id", "hub", "component"), "jaccard-named")
    mixed = written(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key"), "jaccard-mixed")
    members = written(named.join(mixed, "key").select("doc_id", "hub", "component").distinct(), "jaccard-members")
    for used in (texts, long, named, mixed):
        drop(used)
    if not members.isEmpty():
        rest = written(members.withColumnRenamed("hub", "gid").join(of("doc_id"), "doc_id").withColumnRenamed("doc_id_set", "set"), "jaccard-rest")
        work = sifted(block_pairs(rest, num, den), num, den)
        drop(rest)
        texts = written(only_ids(docs, work.select("doc_id")), "jaccard-texts")
        more = written(verified_blocks(work, texts, words, num, den), "jaccard-more")
        drop(texts)
        drop(work)
        if not more.isEmpty():
            labels = written(connected(links.unionByName(more)), "jaccard-labels")
    for used in (lists, members, first, about):
        drop(used)
    sizes = written(sets.select("doc_id", "n_shingles"), "jaccard-sizes")
    drop(sets)
    return sizes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op3_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"), words=3, num=90, den=100)


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, m.y AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON d.doc_id = m.x
"""
