"""Language-model scores with a gated recurrent network, trained in numpy.

All tokens of all documents are counted first, apart for training rows. The most frequent training tokens are the network's own
vocabulary, which grows with the square root of the training tokens, up to HEAD; every other token is the network's `unknown`, and its
share is split by the counts. The output softmax has two factors, the
class of a token and the token in its class, with classes of about equal frequency; both start from the counts over the whole corpus.
Training is truncated backpropagation: windows of TIME steps, the state carried from one to the next. A sample of SAMPLE_DOCS rows gives
the weights to start from; then each partition of the training rows makes a gradient pass over all of its documents, and the weights are
the mean of the partitions' weights by their tokens. Scoring carries the state through a document of any length, so its log-likelihood is
that of the complete text. Both run documents through a fixed number of lanes, a window of steps at a time (`lanes.windows`): memory has a
bound whatever the lengths, and a lane whose document ends takes the next one at once. Texts become the network's numbers once, in a
table that training and scoring read.

Counts of frequent tokens (at most HEAD of them, by a threshold on their counts) are broadcast. Rarer tokens are joined with the count
table; none of them is frequent, in training rows or elsewhere, so this join has no hot key.

Edge cases: a null or blank text is one token, its end; rows that repeat are scored alike; without training tokens every count is 0,
N and V are 0 and both scores come from the uniform remainder; very long texts keep their lane for longer, and their words are read from
a mebibyte at a time.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import bounded_sample, byte_list, crc_mod, slices, table, token_lists, written
from .lanes import Window, windows

HEAD = 65_536
VOCABULARY = 1024
CLASSES = 32
HIDDEN = 16
TIME = 32
SAMPLE_DOCS = 600
PART = 1 << 14
LANES = 512
ROWS = 2048
#: The network tells this many tokens of a class apart, the most frequent ones; it knows the classes of the others.
TOLD_APART = 4096
#: Rare tokens with their counts that a row of the table of scores holds at most.
TAIL = 20_000
END = b""
#: The network's numbers as they are written; there are at most HEAD.
ID = np.dtype("<u2")


class Gru:
    """Token ids: 0 unknown, 1 end, then the vocabulary by falling frequency. A document's first input is the end token."""

    def __init__(self, frequency: np.ndarray, hidden: int = HIDDEN, classes: int = CLASSES, seed: int = 11) -> None:
        rng, v = np.random.default_rng(seed), len(frequency)
        order = np.argsort(-frequency, kind="stable")
        mass = np.cumsum(np.sqrt(frequency[order] + 1.0))
        of = np.minimum((mass - 0.5 * mass[0]) / mass[-1] * classes, classes - 1).astype(np.int64)
        of = np.unique(of, return_inverse=True)[1]
        #: Tokens are renumbered by frequency inside, so that a class is a range.
        self.rank = np.empty(v, np.int32)
        self.rank[order] = np.arange(v)
        self.class_of = of
        self.bounds = np.concatenate(([0], np.cumsum(np.bincount(of))))
        f = frequency[order] + 1.0
        in_class = np.add.reduceat(f, self.bounds[:-1])
        s = 1 / np.sqrt(hidden)
        self.p = {
            "x": rng.normal(0, s, (v, 3 * hidden)), "u": rng.normal(0, s, (hidden, 3 * hidden)),
            "c": rng.normal(0, 0.1 * s, (hidden, len(in_class))), "cb": np.log(in_class / in_class.sum()),
            "w": rng.normal(0, 0.1 * s, (hidden, v)), "wb": np.log(f / in_class[of]),
        }
        self.p = {k: a.astype(np.float32) for k, a in self.p.items()}
        self.hidden = hidden
        #: Classes whose tokens the network tells apart; tokens of the others have their share of the class by their counts.
        self.learnt = int(np.searchsorted(self.bounds, TOLD_APART, side="left"))
        told = self.bounds[min(self.learnt, len(in_class))]
        self.share = np.log(f / in_class[of]).astype(np.float32)[told:]
        self.p["w"], self.p["wb"] = np.ascontiguousarray(self.p["w"][:, :told]), self.p["wb"][:told]

    def _by_gate(self) -> np.ndarray:
        """The weights of the states by z, r and the fresh state: (3, hidden, hidden)."""
        return np.ascontiguousarray(self.p["u"].reshape(self.hidden, 3, self.hidden).transpose(1, 0, 2))

    def run(self, w: Window, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, ...]:
        """States after each step (steps, lanes, hidden) of a window, from the lanes' states before it. With `keep`, what training needs
        of each step, too: the state before, both gates, the fresh state, and the state's own part of what goes into it. Gates lie one
        after another, each in one piece."""
        n, x, u_all = self.hidden, self.p["x"], self._by_gate()
        u_all[:2] *= -1  # what goes into the gates is wanted with the other sign
        steps, lanes = w.target.shape
        out, u = np.empty((steps, lanes, n), np.float32), np.empty((3, lanes, n), np.float32)
        before, all_fresh, all_u = (np.empty((steps if keep else 1, lanes, n), np.float32) for _ in range(3))
        all_gates = np.empty((2, len(before), lanes, n), np.float32)
        begins = w.starts.any(1)
        with np.errstate(over="ignore"):
            for t in range(steps):
                if begins[t]:
                    h = np.where(w.starts[t, :, None], np.float32(0), h)
                k = t if keep else 0
                gates, fresh = all_gates[:, k], all_fresh[k]
                a = x.take(w.inputs[t], axis=0).reshape(lanes, 3, n)
                np.matmul(h, u_all, out=u)
                if keep:
                    before[k] = h
                    all_u[k] = u[2]
                np.subtract(u[:2], a[:, :2].transpose(1, 0, 2), out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                np.multiply(gates[1], u[2], out=fresh)
                fresh += a[:, 2]
                np.tanh(fresh, out=fresh)
                np.subtract(h, fresh, out=out[t])
                out[t] *= gates[0]
                out[t] += fresh
                h = out[t]
        return (out, before, all_gates, all_fresh, all_u) if keep else (out,)

    @staticmethod
    def _exponentials(h: np.ndarray, weights: np.ndarray, steep: bool, own: tuple | None) -> tuple[np.ndarray | None, np.ndarray, np.ndarray]:
        """The targets' logits, if `own` are their places, the exponentials of all logits and the sums of these."""
        z = h @ weights
        if steep:
            z -= z.max(1, keepdims=True)
        found, e = None if own is None else z[own], np.exp(z, out=z)
        return found, e, e @ np.ones(e.shape[1], np.float32)

    @staticmethod
    def _back(h: np.ndarray, e: np.ndarray, total: np.ndarray, own: tuple, scale: np.ndarray, weights: np.ndarray, d_weights: np.ndarray, d_bias: np.ndarray) -> np.ndarray:
        """Adds to the gradients of weights (transposed) and bias; the states' gradient."""
        e[own] -= total
        by = -scale / total
        d_weights += e.T @ (h * by[:, None])
        d_bias += by @ e
        d = e @ weights.T
        d *= by[:, None]
        return d

    def log_p(self, h: np.ndarray, target: np.ndarray, grad: dict | None = None, scale: float | np.ndarray = 1.0):
        """Natural log-probability of each target after its state; with `grad`, adds gradients and returns that of the states instead."""
        cls, rows = self.class_of[target], np.arange(len(h))
        order = np.argsort(cls.astype(np.int16), kind="stable")
        n, h, target, cls = self.hidden, h.take(order, axis=0), target[order], cls[order]
        scale = np.broadcast_to(np.asarray(scale, np.float32), len(h))[order]
        out, d_h = np.empty(len(h), np.float32), None if grad is None else np.empty_like(h)
        # The biases are the weights' last row, for a last column of ones.
        states = np.concatenate([h, np.ones((len(h), 1), h.dtype)], 1)
        both = {k: np.concatenate([self.p[k], self.p[k + "b"][None]]) for k in "cw"}
        d_both = {} if grad is None else {k: np.zeros(a.T.shape, np.float32) for k, a in self.p.items() if k in both}
        # States lie between -1 and 1, so small weights can't overflow.
        steep = {k: bool(np.abs(a).sum(0).max(initial=0) > 60) for k, a in both.items()}
        for i in range(0, len(h), ROWS):  # few enough for the logits to stay in a cache
            own, j = (rows[: len(h) - i][:ROWS], cls[i : i + ROWS]), i + ROWS
            z, e, total = self._exponentials(states[i:j], both["c"], steep["c"], own if grad is None else None)
            if grad is None:
                out[i:j] = z - np.log(total)
            else:
                d_h[i:j] = self._back(h[i:j], e, total, own, scale[i:j], self.p["c"], d_both["c"], grad["cb"])
        cuts = np.searchsorted(cls, np.arange(len(self.bounds)))
        told = len(self.p["wb"])
        if grad is None and self.learnt < len(cuts):
            out[cuts[self.learnt] :] += self.share[target[cuts[self.learnt] :] - told]
        for k in np.flatnonzero(np.diff(cuts[: self.learnt + 1])).tolist():
            i, j, a, b = cuts[k], cuts[k + 1], self.bounds[k], self.bounds[k + 1]
            if b - a == 1:
                continue
            own = (rows[: j - i], target[i:j] - a)
            z, e, total = self._exponentials(states[i:j], both["w"][:, a:b], steep["w"], own if grad is None else None)
            if grad is None:
                out[i:j] += z - np.log(total)
            else:
                d_h[i:j] += self._back(h[i:j], e, total, own, scale[i:j], self.p["w"][:, a:b], d_both["w"][a:b], grad["wb"][a:b])
        for k, d in d_both.items():
            grad[k] += d.T
        back = np.empty_like(order)
        back[order] = rows
        return out[back] if grad is None else d_h.take(back, axis=0)

    def train(self, ids: np.ndarray, lengths: np.ndarray, epochs: int = 4, width: int = 64, rate: float = 0.003) -> None:
        """Adam with a falling rate over windows of TIME steps; the gradient stops at a window's edge, the state doesn't."""
        sequences, adam = cut(ids, lengths), Adam(self.p)
        all_updates = epochs * (1 + len(ids) // (TIME * min(width, len(sequences))))
        for _ in range(epochs):
            for grad in self.gradients(iter(sequences), width):
                adam.update(self.p, grad, rate * max(0.02, 1 - adam.updates / all_updates))

    def gradients(self, sequences: Iterator[np.ndarray], width: int) -> Iterator[dict]:
        """Of each window in turn, at the weights as they are then; windows of few lanes, when sequences run out, are put together. `x`
        comes as rows and their gradients."""
        n, h = self.hidden, np.zeros((0, self.hidden), np.float32)
        grad, seen = None, 0.0
        for w in windows(((k, self.rank[s]) for k, s in enumerate(sequences)), width, TIME, int(self.rank[1])):
            states, before, gates, fresh, u = self.run(w, w.resumed(h), keep=True)
            grad = grad or {k: [] if k == "x" else np.zeros_like(a) for k, a in self.p.items()}
            d_out = self.log_p(states.reshape(-1, n), w.target.ravel(), grad, w.held.ravel())
            d_out = d_out.reshape(states.shape)
            back = np.ascontiguousarray(self._by_gate().transpose(0, 2, 1))
            # What doesn't depend on the steps after it, for all steps at once: the share of a state's gradient that goes to z, to r, and
            # through r to the state before.
            z, r = gates
            share, to_fresh = np.empty((3, *z.shape), np.float32), 1 - z
            np.subtract(before, fresh, out=share[0])
            share[0] *= z
            share[0] *= to_fresh
            fresh *= fresh
            to_fresh *= np.subtract(1, fresh, out=fresh)
            np.multiply(to_fresh, r, out=share[2])
            np.subtract(1, r, out=share[1])
            share[1] *= share[2]
            share[1] *= u
            carried, begins = np.zeros_like(d_out[0]), w.starts.any(1)
            through = np.empty((3, *carried.shape), np.float32)
            for t in range(len(z) - 1, -1, -1):
                d, own = d_out[t], share[:, t]
                d += carried
                own *= d
                np.multiply(d, z[t], out=carried)
                np.matmul(own, back, out=through)
                for part in through:
                    carried += part
                if begins[t]:
                    carried[w.starts[t]] = 0
            before = before.reshape(-1, n)
            grad["u"] += np.concatenate([before.T @ own.reshape(-1, n) for own in share], 1)
            np.multiply(d_out, to_fresh, out=share[2])
            grad["x"].append((w.inputs.ravel(), share.reshape(3, -1, n)))
            seen += float(w.held.sum())
            h = states[-1]
            if seen >= 0.75 * width * TIME:
                yield self._mean(grad, seen)
                grad, seen = None, 0.0
        if grad:
            yield self._mean(grad, seen)

    def _mean(self, grad: dict, seen: float) -> dict:
        rows, parts = (np.concatenate(a, -1 - k) if len(grad["x"]) > 1 else a[0] for k, a in enumerate(zip(*grad["x"], strict=True)))
        order = np.argsort(rows.astype(np.uint16) if len(self.class_of) <= 1 << 16 else rows, kind="stable")
        rows = rows[order]
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out = {k: a for k, a in grad.items() if k != "x"}
        for a in out.values():
            a /= np.float32(seen)
        x = np.concatenate([np.add.reduceat(part.take(order, axis=0), first) for part in parts], 1)
        x /= np.float32(seen)
        return out | {"x": (rows[first], x)}

    def scores(self, sequences: Iterator[tuple], width: int = LANES) -> Iterator[tuple]:
        """(tag, log10-likelihood) of (tag, ids) as sequences end; tags must differ. The state runs through whole sequences, window by window."""
        sums: dict = {}
        h = np.zeros((0, self.hidden), np.float32)
        for w in windows(((tag, self.rank[s]) for tag, s in sequences), width, 2 * TIME, int(self.rank[1])):
            (states,) = self.run(w, w.resumed(h))
            found = self.log_p(states.reshape(-1, self.hidden), w.target.ravel()).reshape(w.target.shape)
            parts = np.add.reduceat(np.where(w.held, found, 0).T.ravel().astype(np.float64), w.first)
            for (tag, done), part in zip(w.parts, parts.tolist(), strict=True):
                sums[tag] = sums.get(tag, 0.0) + part
                if done:
                    yield tag, sums.pop(tag) / np.log(10)
            h = states[-1]

    def log10_likelihood(self, ids: np.ndarray, lengths: np.ndarray, width: int = LANES) -> np.ndarray:
        """For each sequence, the sum over its tokens."""
        out = np.zeros(len(lengths))
        for k, v in self.scores(enumerate(cut(ids, lengths)), width):
            out[k] = v
        return out


class Adam:
    """With `x` given as rows and their gradients, only these rows and their moments move."""

    def __init__(self, p: dict) -> None:
        self.m, self.v = ({k: np.zeros_like(a) for k, a in p.items()} for _ in range(2))
        self.updates = 0

    def update(self, p: dict, grad: dict, rate: float) -> None:
        self.updates += 1
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in (v[1] if isinstance(v, tuple) else v for v in grad.values())))
        now, shrink = rate * min(1.0, self.updates / 20), np.float32(min(1.0, 1.0 / (norm + 1e-9)))
        for name, g in grad.items():
            rows = slice(None)
            if isinstance(g, tuple):
                rows, g = g
            g *= shrink
            m, v = self.m[name][rows], self.v[name][rows]
            m += np.float32(0.1) * (g - m)
            g *= g
            v += np.float32(0.001) * (g - v)
            step = np.sqrt(v * np.float32(1 / (1 - 0.999**self.updates)))
            step += np.float32(1e-6)
            np.divide(m, step, out=step)
            step *= np.float32(now / (1 - 0.9**self.updates))
            p[name][rows] += step
            if not isinstance(rows, slice):
                self.m[name][rows], self.v[name][rows] = m, v


def cut(ids: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, np.cumsum(lengths)[:-1])


def count_tokens(docs: DataFrame, held_out_rest: int, mod: int, text: str, key: str, most: int = 400_000) -> DataFrame:
    """token (binary, the end is empty), n_train, n_all over all rows. Tasks count first and send each distinct token once, or again
    whenever `most` are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        train, rest = Counter(), Counter()

        def flush():
            tokens = list(train.keys() | rest.keys())
            own = [train[t] for t in tokens]
            return pa.RecordBatch.from_arrays([pa.array(tokens, pa.binary()), pa.array(own, pa.int64()), pa.array([a + rest[t] for a, t in zip(own, tokens, strict=True)], pa.int64())], ["token", "n_train", "n_all"])

        for b in batches:
            for i, data in zip(b.column(key).to_pylist(), byte_list(b, text), strict=True):
                own = rest if zlib.crc32(b"" if i is None else str(i).encode()) % mod == held_out_rest else train
                for tokens in token_lists(data):
                    own.update(tokens)
                    if len(train) + len(rest) > most:
                        yield flush()
                        train.clear()
                        rest.clear()
                own[END] += 1
        yield flush()

    parts = docs.select(key, text).mapInArrow(run, "token binary, n_train long, n_all long")
    return parts.groupBy("token").agg(F.sum("n_train").alias("n_train"), F.sum("n_all").alias("n_all"))


def head_tokens(counts: DataFrame, most: int = HEAD) -> tuple[list, int]:
    """Rows of all tokens whose count reaches a threshold, which at most `most` tokens do, and the threshold. The counts' histogram
    has a few rows for each power of two, so what the driver reads has a bound."""
    level = F.floor(F.log2("n_all") * 8)
    histogram = sorted(((r[0], r[1]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for k, n in histogram:
        if total + n > most:
            break
        total, least = total + n, k
    if least is None:
        return [], 1 << 62
    return counts.filter(level >= least).collect(), least


def vocabulary(total: int) -> int:
    """The network's tokens, unknown and end among them, for so many training tokens; HEAD is the most that is broadcast."""
    return max(VOCABULARY, min(HEAD, int(total**0.5)))


def average_pass(train: DataFrame, ids: str, gru: Gru, total: int, rate: float = 0.003) -> None:
    """A gradient pass of each partition over all of its rows (`ids` as of `Encoded`), from the network's weights, which become the mean
    over the partitions. Partitions are put together until one's text is some ten times the model, which each of them sends. Weights are
    summed in parts, so that no task and not the driver holds more than one model beside its own part."""
    spark = train.sparkSession
    held, size, model = spark.sparkContext.broadcast(gru), sum(a.nbytes for a in gru.p.values()), gru
    parts = max(2 * spark.sparkContext.defaultParallelism, 6 * total // (10 * size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gru, seen = held.value, [0]
        before = {k: a.copy() for k, a in gru.p.items()}

        def sequences():
            for b in slices(batches, ids):
                for data in b.column(ids).to_pylist():
                    sequence = np.frombuffer(data, ID)
                    seen[0] += len(sequence)
                    yield sequence

        adam = Adam(gru.p)
        for grad in gru.gradients(sequences(), min(4096, max(64, len(gru.class_of) // 32))):
            adam.update(gru.p, grad, rate)
        after, gru.p = gru.p, before  # another task of this worker starts from the same weights
        if seen[0]:
            for name, a in after.items():
                for k in range(0, a.size, PART):
                    moved = ((a.ravel()[k : k + PART] - before[name].ravel()[k : k + PART]) * np.float32(seen[0])).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, k, seen[0], moved)], ["name", "at", "seen", "moved"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(group["moved"].iloc[0]) // 4)
        for m in group["moved"]:
            total += np.frombuffer(m, np.float32)
        return pd.DataFrame({"name": group["name"].iloc[:1], "at": group["at"].iloc[:1], "moved": [(total / group["seen"].sum()).astype(np.float32).tobytes()]})

    moved = train.select(ids).coalesce(parts).mapInArrow(run, "name string, at long, seen long, moved binary").groupBy("name", "at").applyInPandas(add, "name string, at long, moved binary")
    for name, at, m in moved.collect():
        own = model.p[name].reshape(-1)
        own[at : at + PART] += np.frombuffer(bytes(m), np.float32)


@dataclass
class Encoded:
    """The network's ids of a text's tokens; of those in the head the sum of log10(count + 1), in all and of the network's unknown ones,
    and how many are known; the tokens beyond the head, with their counts, in lists of at most TAIL."""

    ids: np.ndarray
    base: float
    lost: float
    known: int
    tails: list[list[tuple]]


class Scorer:
    """What tasks need: head tokens with counts, the network, and the totals."""

    def __init__(self, head: list, total: int, distinct: int) -> None:
        head = sorted(head, key=lambda r: (-r.n_train, bytes(r.token)))
        self.index = {bytes(r.token): i for i, r in enumerate(head)}
        #: The last is for tokens beyond the head, here and in `ids`.
        self.log_count = np.log10(np.array([*(r.n_train + 1.0 for r in head), 1.0]))
        self.known = np.array([*(r.n_train > 0 for r in head), False])
        inner = [r for r in head if r.n_train > 0 and bytes(r.token) != END][: vocabulary(total) - 2]
        self.ids = np.zeros(len(head) + 1, np.int32)
        frequency = np.zeros(2 + len(inner))
        for k, r in enumerate(inner, 2):
            self.ids[self.index[bytes(r.token)]] = k
            frequency[k] = r.n_train
        ends = next((r.n_train for r in head if bytes(r.token) == END), 0)
        if END in self.index:
            self.ids[self.index[END]] = 1
        frequency[1] = ends
        self.unknown = max(0, total - int(frequency.sum()))
        frequency[0] = self.unknown
        self.unknown_log = np.log10(self.unknown + max(0, distinct - len(inner) - (ends > 0)) + 1.0)
        self.gru = Gru(frequency, classes=max(CLASSES, int(len(frequency) ** 0.5 / 2)))

    def network_ids(self, data: bytes | None) -> np.ndarray:
        get, n = self.index.get, len(self.index)
        codes = [np.fromiter(map(get, tokens, repeat(n)), np.int32, len(tokens)) for tokens in token_lists(data)]
        return self.ids[np.concatenate([*codes, [get(END, n)]])]

    def encode(self, data: bytes | None) -> Encoded:
        get, n, parts, tail, tails = self.index.get, len(self.index), [], Counter(), []
        for tokens in token_lists(data):
            codes = np.fromiter(map(get, tokens, repeat(n)), np.int32, len(tokens))
            parts.append(codes)
            tail.update([tokens[i] for i in np.flatnonzero(codes == n).tolist()])
            if len(tail) >= TAIL:
                tails, tail = tails + pieces_of(tail), Counter()
        end = get(END, n)
        parts.append(np.array([end], np.int32))
        if end == n:
            tail[END] += 1
        codes = np.concatenate(parts)
        ids, logs = self.ids[codes], self.log_count[codes]
        return Encoded(ids, float(logs.sum()), float(logs[ids == 0].sum()), int(self.known[codes].sum()), tails + pieces_of(tail))


def pieces_of(tail: Counter) -> list[list[tuple]]:
    items = list(tail.items())
    return [items[k : k + TAIL] for k in range(0, len(items), TAIL)]


def encoded(docs: DataFrame, key: str, text: str, scorer: Scorer) -> DataFrame:
    """For each row a uid, row_key, n_tokens, n_known, base, rest (what its score has besides the network's and its tails' part) and ids;
    and rows with its uid, no ids and one tail each."""
    held, key_field = docs.sparkSession.sparkContext.broadcast(scorer), docs.schema[key].dataType
    types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.map_(pa.binary(), pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, uid, key_type = held.value, TaskContext.get().partitionId() << 33, to_arrow_type(key_field)
        for b in slices(batches, text):
            uids, keys, rows = [], [], []
            for k, data in zip(b.column(key), byte_list(b, text), strict=True):
                f = model.encode(data)
                rest = f.lost - int((f.ids == 0).sum()) * model.unknown_log
                rows.append((len(f.ids), f.known, f.base, rest, f.ids.astype(ID).tobytes(), None))
                rows += [(*[None] * 5, part) for part in f.tails]
                uids += [uid] * (1 + len(f.tails))
                keys += [k.as_py(), *[None] * len(f.tails)]
                uid += 1
            columns = [pa.array(uids, pa.int64()), pa.array(keys, key_type), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, ["uid", "row_key", "n_tokens", "n_known", "base", "rest", "ids", "tail"])

    return docs.select(key, text).mapInArrow(run, f"uid long, row_key {key_field.simpleString()}, n_tokens long, n_known long, base double, rest double, ids binary, tail map<binary,long>")


def score_documents(docs: DataFrame, key: str, text: str = "text", mod: int = 7, held_out_rest: int = 2, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score for each row. Rows with crc32(key) mod `mod` = held_out_rest teach
    nothing. The network's weights start from a sample of about sample_docs training rows and learn from all of them; counts cover every row."""
    spark = docs.sparkSession
    counts = written(count_tokens(docs, held_out_rest, mod, text, key), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    head, least = head_tokens(counts)
    scorer = Scorer(head, total, distinct)
    key_field = docs.schema[key].dataType
    rows = written(encoded(docs, key, text, scorer), "lm-rows")
    whole_rows = rows.filter("ids IS NOT NULL")
    sample = bounded_sample(docs.filter(crc_mod(key, mod) != held_out_rest).select(key, text), key, sample_docs)
    sample = [bytes(r[0]) if r[0] is not None else None for r in sample.select(F.col(text).cast("binary")).collect()]
    if sample:
        ids = [scorer.network_ids(d) for d in sorted(sample, key=lambda d: d or b"")]
        scorer.gru.train(np.concatenate(ids), np.array(list(map(len, ids))))
        average_pass(whole_rows.filter(crc_mod("row_key", mod) != held_out_rest), "ids", scorer.gru, total)
    held = spark.sparkContext.broadcast(scorer.gru)
    names = ["uid", "row_key", "n_tokens", "n_known", "base", "rest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A batch goes on when all of its rows have ended."""
        waiting: dict = {}

        def sequences():
            for k, b in enumerate(slices(batches, "ids")):
                waiting[k] = b.select(names), np.full(b.num_rows, np.nan)
                for i, data in enumerate(b.column("ids").to_pylist()):
                    yield (k, i), np.frombuffer(data, ID)

        left = Counter()
        for (k, i), found in held.value.scores(sequences()):
            b, lm = waiting[k]
            lm[i] = found
            left[k] += 1
            if left[k] == b.num_rows:
                del waiting[k], left[k]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lm)], [*names, "lm"])

    scored = written(whole_rows.select(*names, "ids").mapInArrow(run, f"uid long, row_key {key_field.simpleString()}, n_tokens long, n_known long, base double, rest double, lm double"), "lm-scored")
    rare = counts.filter(F.floor(F.log2("n_all") * 8) < least).select("token", "n_train")
    tails = rows.filter("tail IS NOT NULL").select("uid", F.explode("tail").alias("token", "n")).join(rare, "token")
    more = tails.groupBy("uid").agg(F.sum(F.log10(F.col("n_train") + 1.0) * F.col("n")).alias("more"), F.sum(F.when(F.col("n_train") > 0, F.col("n")).otherwise(0)).alias("more_known"))
    out = scored.join(more, "uid", "left").fillna(0, ["more", "more_known"])
    whole = np.log10(float(total + distinct + 1))
    return out.select(
        F.col("row_key").alias(key), "n_tokens", (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("more") - F.col("n_tokens") * F.lit(float(whole))).alias("base_score"),
        (F.col("lm") + F.col("rest") + F.col("more")).alias("score"),
    )


def op2_lm_score(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_documents(docs, "doc_id")
    return found.select("doc_id", (crc_mod("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
