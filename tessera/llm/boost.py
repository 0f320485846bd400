"""Gradient-boosted trees for two classes in NumPy: small models that travel inside a task."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow trees on features cut into at most 32 bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, leaf: float = 5.0):
        self.rounds, self.depth, self.rate, self.leaf = rounds, depth, rate, leaf
        self.trees: list[list[tuple[int, float]]] = []
        self.values: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(cut, c, side="left") for cut, c in zip(cuts, x.T, strict=True)], axis=1)
        share = np.clip(y.mean(), 1e-4, 1 - 1e-4)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
            node = np.zeros(len(y), dtype=int)
            tree: list[tuple[int, float]] = []
            for level in range(self.depth):
                for leaf in range(1 << level):
                    rows = node == leaf + (1 << level) - 1
                    best = self._split(bins[rows], grad[rows], hess[rows], cuts)
                    tree.append(best)
                first = (1 << level) - 1
                feature = np.array([t[0] for t in tree])[node]
                cut = np.array([t[1] for t in tree])[node]
                right = x[np.arange(len(x)), np.maximum(feature, 0)] > cut
                node = 2 * (node - first) + right + (2 << level) - 1
            at = node - ((1 << self.depth) - 1)
            g = np.bincount(at, grad, 1 << self.depth)
            h = np.bincount(at, hess, 1 << self.depth)
            value = self.rate * g / (h + self.leaf / 5)
            self.trees.append(tree)
            self.values.append(value)
            score += value[at]
        return self

    def _split(self, bins, grad, hess, cuts) -> tuple[int, float]:
        best, gain = (-1, np.inf), 1e-6
        g, h = grad.sum(), hess.sum()
        for f, cut in enumerate(cuts):
            if not len(cut) or not len(grad):
                continue
            left_g = np.bincount(bins[:, f], grad, len(cut) + 1).cumsum()[:-1]
            left_h = np.bincount(bins[:, f], hess, len(cut) + 1).cumsum()[:-1]
            gains = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g * g / (h + 1)
            gains[(left_h < self.leaf / 10) | (h - left_h < self.leaf / 10)] = 0
            i = int(gains.argmax())
            if gains[i] > gain:
                best, gain = (f, float(cut[i])), gains[i]
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row."""
        x = np.asarray(x, float)
        score = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for tree, value in zip(self.trees, self.values, strict=True):
            features = np.array([t[0] for t in tree])
            cut = np.array([t[1] for t in tree])
            node = np.zeros(len(x), dtype=int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, np.maximum(features[node], 0)] > cut[node])
            score += value[node - ((1 << self.depth) - 1)]
        return 1 / (1 + np.exp(-score))
