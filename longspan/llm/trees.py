"""Gradient-boosted regression trees over binned features, small enough to ship in a closure."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Least-squares boosting with trees of a fixed depth; features are cut at quantiles of the training rows."""

    def __init__(self, rounds: int = 120, depth: int = 3, rate: float = 0.1, bins: int = 32, least: int = 8) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.base = 0.0
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        n, m = b.shape
        self.base = float(y.mean()) if n else 0.0
        at = np.full(n, self.base)
        inner = 2**self.depth - 1
        for _ in range(self.rounds):
            residual = y - at
            feature, cut, value = np.zeros(inner, int), np.full(inner, self.bins + 1), np.zeros(2**self.depth)
            node = np.zeros(n, int)
            for level in range(self.depth):
                first, width = 2**level - 1, 2**level
                best = np.zeros(width)
                total_n = np.bincount(node, minlength=width)
                total_r = np.bincount(node, residual, minlength=width)
                for j in range(m):
                    size = self.bins + 1
                    key = node * size + b[:, j]
                    cn = np.bincount(key, minlength=width * size).reshape(width, size).cumsum(1)
                    cr = np.bincount(key, residual, minlength=width * size).reshape(width, size).cumsum(1)
                    rn, rr = total_n[:, None] - cn, total_r[:, None] - cr
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = cr**2 / cn + rr**2 / rn - (total_r**2 / np.maximum(total_n, 1))[:, None]
                    gain[(cn < self.least) | (rn < self.least)] = 0.0
                    k = gain.argmax(1)
                    g = gain[np.arange(width), k]
                    better = g > best + 1e-9
                    best[better] = g[better]
                    feature[first : first + width][better] = j
                    cut[first : first + width][better] = k[better]
                node = node * 2 + (b[np.arange(n), feature[first + node]] > cut[first + node])
            cn = np.bincount(node, minlength=2**self.depth)
            value = self.rate * np.bincount(node, residual, minlength=2**self.depth) / np.maximum(cn, 1)
            at = at + value[node]
            self.trees.append((feature, cut, value))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        n = len(b)
        rows = np.arange(n)
        at = np.full(n, self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(n, int)
            for level in range(self.depth):
                k = 2**level - 1 + node
                node = node * 2 + (b[rows, feature[k]] > cut[k])
            at += value[node]
        return at
