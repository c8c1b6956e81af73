"""Gradient-boosted trees for yes or no, over binned features, in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Trees of one depth; leaves add up to log odds."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)])  # bin b: above edge b - 1
        share = np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        score, inner = np.full(len(y), self.base), 2**self.depth - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, cut, at = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
            for d in range(self.depth):
                first, width = 2**d - 1, 2**d
                best = np.full(width, 1e-6)
                place = at - first
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = place * (len(e) + 1) + binned[j]
                    left_g, left_h = (np.cumsum(np.bincount(k, v, width * (len(e) + 1)).reshape(width, -1), axis=1) for v in (g, h))
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    a, b = left_g[:, :-1], left_h[:, :-1]
                    gain = a**2 / (b + self.penalty) + (all_g - a) ** 2 / (all_h - b + self.penalty) - all_g**2 / (all_h + self.penalty)
                    top = gain.argmax(axis=1)
                    better = np.flatnonzero(gain[np.arange(width), top] > best)
                    best[better] = gain[better, top[better]]
                    feature[first + better], cut[first + better] = j, e[top[better]]
                at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
            leaf = at - inner
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.penalty)
            score += value[leaf]
            self.trees.append((feature, cut.astype(np.float32), value))
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - len(feature)]
        return out
