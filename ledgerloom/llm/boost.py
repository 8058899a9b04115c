"""Gradient-boosted trees for two classes, in NumPy: histograms, log loss, complete trees."""

from __future__ import annotations

import numpy as np


class Boosted:
    """``rounds`` trees of ``depth`` levels, fitted with second-order steps, each on a share of the columns."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, columns: float = 1.0, seed: int = 1):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.columns, self.rng = columns, np.random.default_rng(seed)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1], method="lower")) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1)
        mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(mean / (1 - mean)))
        margin = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            margin += self._grow(binned, y - p, p * (1 - p))
        return self

    def _grow(self, binned: np.ndarray, grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(grad), int)
        tried = np.sort(self.rng.permutation(len(self.edges))[: max(1, round(self.columns * len(self.edges)))])
        for level in range(self.depth):
            first, many = 2**level - 1, 2**level
            own = node - first
            g_all, h_all = (np.bincount(own, x, many) for x in (grad, hess))
            whole, best = g_all**2 / (h_all + self.ridge), np.full(many, 1e-6)
            for j in tried:
                edges = self.edges[j]
                if not len(edges):
                    continue
                bins = len(edges) + 1
                at = own * bins + binned[:, j]
                left_g, left_h = (np.cumsum(np.bincount(at, x, many * bins).reshape(many, bins), axis=1)[:, :-1] for x in (grad, hess))
                gain = left_g**2 / (left_h + self.ridge) + (g_all[:, None] - left_g) ** 2 / (h_all[:, None] - left_h + self.ridge) - whole[:, None]
                k = np.argmax(gain, axis=1)
                top = gain[np.arange(many), k]
                better = np.flatnonzero(top > best)
                best[better], feature[first + better], cut[first + better] = top[better], j, k[better]
            node = 2 * node + 1 + (binned[np.arange(len(node)), feature[node]] > cut[node])
        leaf = node - inner
        value = self.rate * np.bincount(leaf, grad, 2**self.depth) / (np.bincount(leaf, hess, 2**self.depth) + self.ridge)
        real = np.array([self.edges[f][int(c)] if np.isfinite(c) else np.inf for f, c in zip(feature, cut, strict=True)])
        self.trees.append((feature, real, value))
        return value[leaf]

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of the positive class."""
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out
