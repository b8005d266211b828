"""Gradient-boosted trees for two classes, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited trees on binned features, fitted to the gradient of the log loss with Newton leaves."""

    def __init__(self, bias: float, rate: float, trees: list) -> None:
        self.bias, self.rate, self.trees = bias, rate, trees

    @staticmethod
    def train(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> BoostedTrees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
        coded = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], 1)
        p = (y.sum() + 0.5) / (len(y) + 1)
        model = BoostedTrees(float(np.log(p / (1 - p))), rate, [])
        raw = np.full(len(y), model.bias)
        for _ in range(rounds):
            q = 1 / (1 + np.exp(-raw))
            g, h = y - q, q * (1 - q)
            tree: dict[int, tuple] = {}
            node = np.zeros(len(y), np.int64)
            for level in range(depth + 1):
                for k in range(2**level - 1, 2 ** (level + 1) - 1):
                    own = np.flatnonzero(node == k)
                    if not len(own):
                        continue
                    total_g, total_h = g[own].sum(), h[own].sum()
                    best = (1e-6, -1, 0)
                    for j in range(x.shape[1]) if level < depth else ():
                        n = len(cuts[j]) + 1
                        lg, lh = np.cumsum(np.bincount(coded[own, j], g[own], n))[:-1], np.cumsum(np.bincount(coded[own, j], h[own], n))[:-1]
                        if len(lg):
                            gain = lg**2 / (lh + ridge) + (total_g - lg) ** 2 / (total_h - lh + ridge) - total_g**2 / (total_h + ridge)
                            c = int(gain.argmax())
                            if gain[c] > best[0]:
                                best = (gain[c], j, c)
                    if best[1] < 0:
                        tree[k] = (-1, total_g / (total_h + ridge))
                        node[own] = -1 - k
                    else:
                        _, j, c = best
                        tree[k] = (j, float(cuts[j][c]))
                        node[own] = 2 * k + 1 + (coded[own, j] > c)
            model.trees.append(tree)
            raw += rate * model._one(tree, x)
        return model

    @staticmethod
    def _one(tree: dict[int, tuple], x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        todo = [(0, np.arange(len(x)))]
        while todo:
            k, own = todo.pop()
            j, v = tree[k]
            if j < 0:
                out[own] = v
                continue
            right = x[own, j] > v
            for child, rows in ((2 * k + 1, own[~right]), (2 * k + 2, own[right])):
                if len(rows):
                    todo.append((child, rows))
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.bias)
        for tree in self.trees:
            raw += self.rate * self._one(tree, x)
        return 1 / (1 + np.exp(-raw))
