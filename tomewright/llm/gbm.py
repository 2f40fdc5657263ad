"""Gradient-boosted trees for small tables of features, in numpy: logistic loss, shallow trees on quantile bins."""

from __future__ import annotations

import numpy as np


class Boosted:
    """A binary classifier; :meth:`score` gives probabilities. Training twice on the same rows gives the same model."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.25, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least, self.ridge = rounds, depth, rate, bins, least, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, k = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        # a cut lies midway between neighbouring values, so that unseen ones fall to the nearer side
        cuts = []
        for j in range(k):
            u = np.unique(x[:, j])
            up = u[np.minimum(np.searchsorted(u, edges[j], "right"), len(u) - 1)]
            cuts.append(np.unique((edges[j] + up) / 2))
        binned = np.stack([np.searchsorted(cuts[j], x[:, j], "left") for j in range(k)], 1)
        p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(n, self.start)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob)
            feat, cut = np.full(inner, -1), np.zeros(inner)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first = (1 << level) - 1
                for at in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == at)
                    if len(rows) < 2 * self.least:
                        continue
                    gs, hs = g[rows].sum(), h[rows].sum()
                    best = 1e-6
                    for j in range(k):
                        if not len(cuts[j]):
                            continue
                        size = len(cuts[j]) + 1
                        gc = np.cumsum(np.bincount(binned[rows, j], g[rows], size))[:-1]
                        hc = np.cumsum(np.bincount(binned[rows, j], h[rows], size))[:-1]
                        c = np.cumsum(np.bincount(binned[rows, j], minlength=size))[:-1]
                        gain = gc**2 / (hc + self.ridge) + (gs - gc) ** 2 / (hs - hc + self.ridge) - gs**2 / (hs + self.ridge)
                        gain[(c < self.least) | (len(rows) - c < self.least)] = 0
                        i = int(gain.argmax())
                        if gain[i] > best:
                            best, feat[at], cut[at] = float(gain[i]), j, cuts[j][i]
                go = feat[node] >= 0
                deeper = node >= first
                right = np.where(go, x[np.arange(n), np.maximum(feat[node], 0)] > cut[node], False)
                node = np.where(deeper, 2 * node + 1 + right, node)
            leaf = node - inner
            gl, hl = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            value = self.rate * gl / (hl + self.ridge)
            f += value[leaf]
            self.trees.append((feat, cut, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.start)
        at = np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                j = feat[node]
                node = 2 * node + 1 + np.where(j >= 0, x[at, np.maximum(j, 0)] > cut[node], False)
            f += value[node - len(feat)]
        return 1 / (1 + np.exp(-f))
