"""A trained scorer of term pairs: a set network over the vectors of both terms and of sampled neighbours that only one of them has.

A pair's members are its two terms and, of each term, at most n of the neighbours that the other lacks. The network takes them as a set:
a linear layer with ReLU, self-attention, a second layer with ReLU, the mean over members and a logistic output. It learns to score a
known pair above pairs of swapped terms and above the pair's own terms amid scrambled neighbours, by a margin.

Spark builds all sets (joins on edges and on vectors) and deals the training groups by a hash of their pair to a fixed number of parts, so a
result doesn't depend on how tables were split. In each round every part goes through its groups from the current weights; the new
weights are the parts' mean, weighted by groups and summed by Spark one weight a row. The driver holds one network, never an example.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import hash64
from ..plans.stage import drop, scratch
from .ranking import in_vocabulary, negative_pairs, sampled_neighbourhoods, scrambled_neighbourhoods


class SetNetwork:
    """Scores of sets of vectors, and their gradients. Sets come padded: x has shape (sets, members, dimensions), `there` says which
    members are real. A set without members scores as one of zero vectors."""

    def __init__(self, dimensions: int, hidden: int = 32, seed: int = 0) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda rows, cols: rng.normal(0, rows**-0.5, (rows, cols))
        self.hidden = hidden
        self.p = {
            "w1": draw(dimensions, hidden) * 2**0.5, "b1": np.zeros(hidden), "wq": draw(hidden, hidden), "wk": draw(hidden, hidden), "wv": draw(hidden, hidden),
            "w2": draw(hidden, hidden) * 2**0.5, "b2": np.zeros(hidden), "w3": draw(hidden, 1)[:, 0], "b3": np.zeros(1),
        }

    def flat(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, flat: np.ndarray) -> SetNetwork:
        at = 0
        for k, v in self.p.items():
            self.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size
        return self

    def forward(self, x: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, tuple]:
        p, real = self.p, there[:, :, None]
        h = np.maximum(x @ p["w1"] + p["b1"], 0) * real
        q, k, v = h @ p["wq"], h @ p["wk"], h @ p["wv"]
        logits = np.where(there[:, None, :], q @ k.transpose(0, 2, 1) / self.hidden**0.5, -1e30)
        a = np.exp(logits - logits.max(axis=2, keepdims=True))
        a /= a.sum(axis=2, keepdims=True)
        z = h + a @ v
        g = np.maximum(z @ p["w2"] + p["b2"], 0) * real
        n = np.maximum(there.sum(axis=1), 1)[:, None]
        mean = g.sum(axis=1) / n
        score = 1 / (1 + np.exp(-np.clip(mean @ p["w3"] + p["b3"], -500, 500)))
        return score, (x, there, h, q, k, v, a, z, g, n, mean, score)

    def scores(self, x: np.ndarray, there: np.ndarray) -> np.ndarray:
        return self.forward(x, there)[0]

    def backward(self, slope: np.ndarray, held: tuple) -> dict[str, np.ndarray]:
        """Gradients of sum(slope * score)."""
        x, there, h, q, k, v, a, z, g, n, mean, score = held
        p, real = self.p, there[:, :, None]
        rows = lambda m: m.reshape(-1, m.shape[-1])
        d_logit = slope * score * (1 - score)
        d_g = (d_logit[:, None] * p["w3"] / n)[:, None, :] * (g > 0) * real
        d_z = d_g @ p["w2"].T
        d_a = d_z @ v.transpose(0, 2, 1)
        d_v = a.transpose(0, 2, 1) @ d_z
        d_s = a * (d_a - (d_a * a).sum(axis=2, keepdims=True)) / self.hidden**0.5
        d_q, d_k = d_s @ k, d_s.transpose(0, 2, 1) @ q
        d_h = (d_z + d_q @ p["wq"].T + d_k @ p["wk"].T + d_v @ p["wv"].T) * (h > 0) * real
        return {
            "w1": rows(x).T @ rows(d_h), "b1": rows(d_h).sum(0), "wq": rows(h).T @ rows(d_q), "wk": rows(h).T @ rows(d_k), "wv": rows(h).T @ rows(d_v),
            "w2": rows(z).T @ rows(d_g), "b2": rows(d_g).sum(0), "w3": mean.T @ d_logit, "b3": d_logit.sum(keepdims=True),
        }

    def margin_step(self, x: np.ndarray, there: np.ndarray, known: np.ndarray, other: np.ndarray, margin: float) -> tuple[float, dict[str, np.ndarray]]:
        """Mean over pairs (known[i], other[i]) of what the known set's score lacks to be `margin` above the other's, and its gradients."""
        score, held = self.forward(x, there)
        lack = margin - score[known] + score[other]
        missed = (lack > 0) / max(len(lack), 1)
        slope = np.bincount(other, missed, len(score)) - np.bincount(known, missed, len(score))
        return float(np.maximum(lack, 0).sum() / max(len(lack), 1)), self.backward(slope, held)


class Adam:
    def __init__(self, rate: float) -> None:
        self.rate, self.t, self.m, self.v = rate, 0, {}, {}

    def step(self, p: dict[str, np.ndarray], grad: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grad.items():
            self.m[k] = 0.9 * self.m.get(k, 0.0) + 0.1 * g
            self.v[k] = 0.999 * self.v.get(k, 0.0) + 0.001 * g * g
            p[k] = p[k] - self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


def padded(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of vectors as one array, and which members are real. There is one place for a member at least."""
    sets = sets.combine_chunks() if isinstance(sets, pa.ChunkedArray) else sets
    sizes = np.array([n or 0 for n in pc.list_value_length(sets).to_pylist()], np.int64)
    vectors = sets.flatten()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    flat = flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))
    x = np.zeros((len(sizes), max(1, sizes.max(initial=0)), flat.shape[1]))
    there = np.arange(x.shape[1]) < sizes[:, None]
    x[there] = flat
    return x, there


@dataclass(frozen=True)
class ScorerSettings:
    """neighbours: at most so many of each term. swaps, scrambles: negatives of each kind for each known pair. pairs: about so many known
    pairs train, picked by hash; this bounds the examples, whatever the graph's size."""

    neighbours: int = 15
    swaps: int = 3
    scrambles: int = 3
    margin: float = 0.1
    hidden: int = 32
    rounds: int = 10
    batch: int = 32
    rate: float = 0.01
    parts: int = 4
    pairs: int = 20_000
    seed: str = "scorer"
    kind: str | None = "predicate"


def members(pairs: DataFrame, edges: DataFrame, settings: ScorerSettings) -> DataFrame:
    """subj, obj, place and name: the two terms (places 0 and 1) and the sampled neighbours of each. The terms themselves are no neighbours."""
    own = pairs.select("subj", "obj").distinct()
    sides = sampled_neighbourhoods(own, edges, settings.neighbours + 2, settings.seed, settings.kind)  # two more, in case the terms are there
    near = F.slice(F.filter("neighbours", lambda x: ~x.isin(F.col("subj"), F.col("obj"))), 1, settings.neighbours)
    first = F.when(F.col("side") == "subj", 2).otherwise(2 + settings.neighbours)
    others = sides.select("subj", "obj", first.alias("first"), F.posexplode(near).alias("k", "name")).select("subj", "obj", (F.col("first") + F.col("k")).alias("place"), "name")
    terms = own.select("subj", "obj", F.posexplode(F.array("subj", "obj")).alias("place", "name"))
    return terms.unionByName(others)


def around(edges: DataFrame, *terms: DataFrame) -> DataFrame:
    """The edges that begin at one of the terms (term), written once: whatever is asked of a term's neighbourhood reads these only."""
    ends = scratch(reduce(DataFrame.union, [t.select("term") for t in terms]).distinct())
    return scratch(edges.select("src", "dst").join(ends.withColumnRenamed("term", "src"), "src", "left_semi"))


def both_terms(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("subj", "obj")).alias("term"))


def with_vectors(rows: DataFrame, vectors: DataFrame, *keys: str) -> DataFrame:
    """The keys and `vectors`, those of their named members in order of place; members without a vector are left out. A busy neighbour's
    rows are split, since they come from a table."""
    dealt = scratch(rows)
    found = dealt.join(vectors.select("name", "embedding").filter("embedding is not null"), "name").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "embedding"))).alias("m"))
    return found.select(*keys, F.transform("m", lambda m: m["embedding"]).alias("vectors"))


def training_groups(positives: DataFrame, edges: DataFrame, vectors: DataFrame, settings: ScorerSettings, subjects: DataFrame | None = None, objects: DataFrame | None = None) -> DataFrame:
    """subj, obj and sets: the vectors of the known pair and of its negatives, those of swapped terms with their own neighbours and those of
    the pair amid neighbours drawn from all. `subjects` and `objects` (term) are what swaps draw from; without them, all terms of either
    end. Known pairs with a term that has no edge are left out."""
    positives = scratch(positives.select("subj", "obj").distinct())  # read for both ends' terms, for what is known and for the pairs
    subjects = positives.select(F.col("subj").alias("term")).distinct() if subjects is None else subjects
    objects = positives.select(F.col("obj").alias("term")).distinct() if objects is None else objects
    near = around(edges, both_terms(positives), subjects, objects)
    known = in_vocabulary(positives, near.select(F.col("src").alias("node")).distinct())
    known = scratch(picked(scratch(known), settings.pairs, settings.seed))
    swaps = scratch(negative_pairs(known, subjects, settings.swaps, settings.seed, objects, positives))
    asked = known.unionByName(swaps.select(F.col("neg_subj").alias("subj"), F.col("neg_obj").alias("obj"))).distinct()
    sets = scratch(with_vectors(members(asked, near, settings), vectors, "subj", "obj"))
    others = edges.select(F.col("dst").alias("predicate"))
    if settings.kind is not None:
        from ..functions.keys import is_type

        others = others.filter(is_type(F.col("predicate"), settings.kind))
    drawn = scrambled_neighbourhoods(known, others.distinct(), settings.scrambles, settings.neighbours, settings.seed)
    terms = known.select("subj", "obj", F.explode(F.sequence(F.lit(1), F.lit(settings.scrambles))).alias("draw")).select("subj", "obj", "draw", F.posexplode(F.array("subj", "obj")).alias("place", "name"))
    amid = with_vectors(terms.unionByName(drawn.select("subj", "obj", "draw", (F.col("k") + 1).cast("int").alias("place"), F.col("predicate").alias("name"))), vectors, "subj", "obj", "draw")
    role = lambda n: F.lit(n).alias("role")
    rows = known.join(sets, ["subj", "obj"]).select("subj", "obj", role(0), F.lit(0).alias("draw"), "vectors")
    swapped = swaps.join(sets.select(F.col("subj").alias("neg_subj"), F.col("obj").alias("neg_obj"), "vectors"), ["neg_subj", "neg_obj"]).select("subj", "obj", role(1), "draw", "vectors")
    rows = rows.unionByName(swapped).unionByName(amid.select("subj", "obj", role(2), "draw", "vectors"))
    groups = rows.groupBy("subj", "obj").agg(F.sort_array(F.collect_list(F.struct("role", "draw", "vectors"))).alias("g"))  # 1 + swaps + scrambles
    return groups.filter((F.size("g") > 1) & (F.get("g", F.lit(0))["role"] == 0)).select("subj", "obj", F.transform("g", lambda g: g["vectors"]).alias("sets"))


def picked(pairs: DataFrame, most: int, seed: str) -> DataFrame:
    """About `most` pairs by hash, all if there are fewer."""
    n = pairs.count()
    return pairs if n <= most else pairs.filter(F.pmod(pair_hash(seed), F.lit(1 << 31)) < int((1 << 31) * most / n))


def pair_hash(seed: str) -> Column:
    return hash64(F.concat_ws("|", "subj", "obj", F.lit(seed)))


@dataclass
class PairScorer:
    """A trained network with its settings; losses[i] is the mean loss of round i's training."""

    network: SetNetwork
    settings: ScorerSettings
    losses: list[float] = field(default_factory=list)

    def score_sets(self, sets: DataFrame) -> DataFrame:
        """Rows with `vectors` get a score in their stead."""
        network, kept = self.network, [c for c in sets.columns if c != "vectors"]

        def work(batches):
            for b in batches:
                for at in range(0, b.num_rows, 256):
                    piece = b.slice(at, 256)
                    score = network.scores(*padded(piece.column("vectors")))
                    yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), pa.array(score)], [*kept, "score"])

        schema = ", ".join(f"`{c}` {t}" for c, t in sets.dtypes if c != "vectors") + ", score double"
        return sets.select(*kept, "vectors").mapInArrow(work, schema)

    def rank_pairs(self, pairs: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
        """The pairs (ord, subj, obj and what else they have) with score, 0 for pairs of which a term has no edges or no vector, in the order
        asked (ord)."""
        known = scratch(in_vocabulary(pairs.select("subj", "obj").distinct(), vectors.select(F.col("name").alias("node")).distinct()))
        near = around(edges, both_terms(known))
        known = in_vocabulary(known, near.select(F.col("src").alias("node")).distinct())
        scored = self.score_sets(with_vectors(members(known, near, self.settings), vectors, "subj", "obj"))
        return pairs.join(scored, ["subj", "obj"], "left").select(*pairs.columns, F.coalesce("score", F.lit(0.0)).alias("score")).orderBy("ord")


def fit_pair_scorer(groups: DataFrame, settings: ScorerSettings | None = None) -> PairScorer:
    """Trains on the groups of `training_groups`. Groups are dealt to `parts` tasks by a hash of their pair and sorted there by another."""
    settings = settings or ScorerSettings()
    part = F.pmod(pair_hash(settings.seed + "part"), F.lit(settings.parts)).cast("int")
    dealt = scratch(groups.select(part.alias("part"), pair_hash(settings.seed + "order").alias("h"), "subj", "obj", "sets"))
    first = dealt.select(F.size(F.get(F.get("sets", F.lit(0)), F.lit(0)))).first()
    if first is None:
        raise ValueError("no known pair has vectors and negatives")
    network, losses = SetNetwork(first[0], settings.hidden), []
    names = ["place", "value", "n"]
    for k in range(settings.rounds):
        start = network.flat()

        def work(batches, start=start, k=k, dimensions=first[0]):
            own, total, n = SetNetwork(dimensions, settings.hidden).load(start), 0.0, 0
            adam = Adam(settings.rate * 0.8**k)
            for b in batches:
                for at in range(0, b.num_rows, settings.batch):
                    some = b.column("sets").slice(at, settings.batch)
                    sizes = pc.list_value_length(some).to_numpy(zero_copy_only=False)
                    begin = np.cumsum(sizes) - sizes
                    known = np.repeat(begin, sizes - 1)
                    other = np.concatenate([np.arange(a + 1, a + s) for a, s in zip(begin, sizes)])
                    loss, grad = own.margin_step(*padded(some.flatten()), known, other, settings.margin)
                    adam.step(own.p, grad)
                    total, n = total + loss * len(some), n + len(some)
            if n:
                flat = np.append(own.flat() * n, total)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat), pa.array(np.full(len(flat), n))], names)

        ordered = dealt.repartition(settings.parts, "part").sortWithinPartitions("part", "h", "subj", "obj").select("sets")
        found = ordered.mapInArrow(work, "place long, value double, n long").groupBy("place").agg(F.sort_array(F.collect_list("value")).alias("v"), F.sum("n").alias("n"))
        total = F.aggregate("v", F.lit(0.0), lambda a, b: a + b)  # in order of size, so that equal parts have equal sums
        mean = found.select("place", (total / F.col("n")).alias("value")).collect()  # one row for each weight of the network
        flat = np.empty(len(mean))
        for r in mean:
            flat[r.place] = r.value
        losses.append(float(flat[-1]))
        network.load(flat[:-1])
    drop(dealt)
    return PairScorer(network, settings, losses)
