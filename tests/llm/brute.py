"""Plain versions of the operators' contracts."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def decontaminated(docs, items, window=10):
    """(n_words, hit places, item ids) for each text."""
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - window, 0) + 1 if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for t in docs:
        w, hit, ids = words(t), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if found := wins.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    ids |= found
        out.append((len(w), hit, ids))
    return out


def components(texts, size, num, den):
    """{id: (set size, smallest id reachable)}"""
    sets = {}
    for i, t in texts.items():
        w = tokens(t)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def without_repeats(texts, width=400):
    """(bytes, removed, spans, sha256 of the rest) for each text."""
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[k : k + width] for b in data for k in range(len(b) - width + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        starts = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((len(b), int(gone.sum()), starts, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return out


def personal(text):
    """Base spans by the rules' own expressions: (kind, start, end)."""
    text = text or ""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 16 <= len(d) <= 19 and sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def log10_of_model(gru, ids):
    """A document's log10 probability, a token at a time, straight from the formulas."""
    p = {k: a.astype(np.float64) for k, a in gru.p.items()}
    n, told = gru.hidden, len(gru.p["wb"])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    softmax = lambda v: np.exp(v - v.max()) / np.exp(v - v.max()).sum()
    h, last, total = np.zeros(n), int(gru.rank[1]), 0.0
    for t in gru.rank[np.asarray(ids)].tolist():
        x, u = p["x"][last], h @ p["u"]
        z, r = sigmoid(x[:n] + u[:n]), sigmoid(x[n : 2 * n] + u[n : 2 * n])
        h = (1 - z) * np.tanh(x[2 * n :] + r * u[2 * n :]) + z * h
        k = gru.class_of[t]
        a, b = gru.bounds[k], gru.bounds[k + 1]
        total += np.log10(softmax(h @ p["c"] + p["cb"])[k])
        if b <= told:
            total += np.log10(softmax(h @ p["w"][:, a:b] + p["wb"][a:b])[t - a])
        else:
            total += float(gru.share[t - told]) / np.log(10)
        last = t
    return total


def vector_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    """{row number: (code, error)} and the final codebooks, for usable (id, vector, label) rows in order of their ids; plain loops."""
    x = [[math.floor(scale * c) for c in v] for _, v, _ in rows]
    edges = [p * len(x[0]) // parts for p in range(parts + 1)]
    books, found = [], [("", 0)] * len(x)
    for a, b in zip(edges, edges[1:]):
        own = [v[a:b] for v in x]
        book = own[:entries]

        def nearest(v, book):
            return min((sum((p - q) ** 2 for p, q in zip(v, c, strict=True)), e) for e, c in enumerate(book))

        for _ in range(rounds):
            groups = collections.defaultdict(list)
            for v in own:
                groups[nearest(v, book)[1]].append(v)
            book = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else old for e, old in enumerate(book)]
        for i, v in enumerate(own):
            d, e = nearest(v, book)
            found[i] = (found[i][0] + f"{e:02x}", found[i][1] + d)
        books.append(book)
    return found, books


def shingles(text, words=5):
    w = tokens(text)
    return {tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def audited(docs, marks):
    """{(part, order, step): (kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)} by going through every order.
    docs: (id, text, lang); marks: {id: (quality, toxic)}."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    seen = []
    for i, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        seen.append((lang or "", {k for k, v in fails.items() if v}, marks.get(i, (0, 0))))
    out = {}
    for part in {p for p, _, _ in seen}:
        share = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = gone = [d for d in seen if d[0] == part]
            gone = []
            for step, k in enumerate(order, 1):
                away, left = [d for d in left if k in d[1]], [d for d in left if k not in d[1]]
                share[k] += len(away)
                out[part, "".join(order), step] = [len(left), len(away), sum(k in d[1] for d in gone), sum(d[0] == part and d[1] == {k} for d in seen), sum(d[2][0] == 1 for d in away), sum(d[2][1] == 1 for d in away)]
                gone += away
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}
