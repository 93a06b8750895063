"""Gradient-boosted trees over dense features and isotonic calibration, in numpy, for a bounded number of rows."""

from __future__ import annotations

import numpy as np

BINS = 64


class Boosted:
    """Logistic boosting of complete trees of a fixed depth, cut at quantiles of the training rows."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 2.0):
        self.rounds, self.depth, self.rate, self.l2 = rounds, depth, rate, l2
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # features, cuts, leaves

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS)[1:-1])) for j in range(m)]
        codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)  # code <= k: x <= edges[k]
        self.start = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        margin = np.full(n, self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            features, cuts, at = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, np.inf), np.zeros(n, int)
            for level in range(self.depth):
                width = 2**level
                best = np.full(width, 1e-6)
                where = np.zeros((width, 2), int) - 1
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    k = at * BINS + codes[:, j]
                    left_g, left_h = (np.bincount(k, v, width * BINS).reshape(width, BINS).cumsum(1) for v in (g, h))
                    all_g, all_h = left_g[:, -1:], left_h[:, -1:]
                    gain = left_g**2 / (left_h + self.l2) + (all_g - left_g) ** 2 / (all_h - left_h + self.l2) - all_g**2 / (all_h + self.l2)
                    gain = gain[:, : len(e)]
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best[better] = gain[np.arange(width), top][better]
                    where[better] = np.stack([np.full(width, j), top], 1)[better]
                for node in range(width):
                    j, k = where[node]
                    if j >= 0:
                        features[width - 1 + node], cuts[width - 1 + node] = j, edges[j][k]
                node = width - 1 + at
                at = 2 * at + (x[np.arange(n), features[node]] > cuts[node])
            sums_g, sums_h = (np.bincount(at, v, 2**self.depth) for v in (g, h))
            leaves = self.rate * sums_g / (sums_h + self.l2)
            self.trees.append((features, cuts, leaves))
            margin += leaves[at]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        for features, cuts, leaves in self.trees:
            at = np.zeros(len(x), int)
            for level in range(self.depth):
                node = 2**level - 1 + at
                at = 2 * at + (x[rows, features[node]] > cuts[node])
            out += leaves[at]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: block means of margins, and rates that never fall."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of margins
    for m, v in zip(margin[order], y[order], strict=True):
        blocks.append([float(v), 1.0, float(m)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([(b[0] + 0.02) / (b[1] + 0.04) for b in blocks])
