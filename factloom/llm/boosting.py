"""Gradient-boosted regression trees for a binary label (logistic loss), on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    edges: list[np.ndarray]
    base: float
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature, bin and value of each node of a full tree
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (b[rows, feature[at]] > cut[at])
            total += value[at]
        return total


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 4.0, ridge: float = 1.0) -> Boosted:
    """Trees of full depth; a node that can't be split sends all its rows to one side."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(edges, float(np.log(p / (1 - p))), [], depth)
    b = model.bins(x).astype(np.int64)
    n_features, width = x.shape[1], bins + 1
    flat = b + np.arange(n_features) * width
    total = np.full(len(x), model.base)
    inner = 2**depth - 1
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-total))
        grad, hess = y - prob, np.maximum(prob * (1 - prob), 1e-6)
        feature, cut, value = np.zeros(2 * inner + 1, np.int64), np.full(2 * inner + 1, width, np.int64), np.zeros(2 * inner + 1)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            key = ((at - first)[:, None] * (n_features * width) + flat).ravel()
            g = np.bincount(key, np.repeat(grad, n_features), n * n_features * width).reshape(n, n_features, width)
            h = np.bincount(key, np.repeat(hess, n_features), n * n_features * width).reshape(n, n_features, width)
            gl, hl = g.cumsum(2), h.cumsum(2)
            gt, ht = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(hl < least) | (ht - hl < least)] = -1
            best = gain.reshape(n, -1).argmax(1)
            top = gain.reshape(n, -1)[np.arange(n), best]
            ok = top > 1e-6
            feature[first : first + n] = np.where(ok, best // width, 0)
            cut[first : first + n] = np.where(ok, best % width, width)
            at = 2 * at + 1 + (b[np.arange(len(x)), feature[at]] > cut[at])
        leaf = at - inner
        gs, hs = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
        value[inner:] = rate * gs / (hs + ridge)
        total += value[at]
        model.trees.append((feature, cut, value))
    return model
