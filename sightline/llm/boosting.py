"""Gradient-boosted trees for binary labels, in NumPy: quantile bins, depth-limited trees, Newton steps."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Boosted:
    rounds: int = 40
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    l2: float = 1.0
    least: int = 5
    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Each tree is complete: per inner node a feature and a cut, per leaf a value; a node without gain sends all left."""
        if not len(y):
            return self
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.base = float(np.log(rate / (1 - rate)))
        self.trees = []
        if y.min() == y.max():
            return self
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        code = np.stack([np.searchsorted(q, c, side="left") for q, c in zip(cuts, x.T, strict=True)], 1)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = sigmoid(score)
            grad, hess = y - p, np.maximum(p * (1 - p), 1e-12)
            node = np.zeros(len(y), dtype=np.int64)
            feature, cut = np.zeros(2**self.depth - 1, dtype=np.int64), np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                width, first = 2**level, 2**level - 1
                best = np.full(width, 1e-9)
                for f, q in enumerate(cuts):
                    if not len(q):
                        continue
                    k = len(q) + 1
                    slot = node * k + code[:, f]
                    g, h, n = (np.bincount(slot, w, width * k).reshape(width, k).cumsum(1) for w in (grad, hess, None))
                    gl, hl, nl = g[:, :-1], h[:, :-1], n[:, :-1]
                    gt, ht, nt = g[:, -1:], h[:, -1:], n[:, -1:]
                    gain = gl**2 / (hl + self.l2) + (gt - gl) ** 2 / (ht - hl + self.l2) - gt**2 / (ht + self.l2)
                    gain[(nl < self.least) | (nt - nl < self.least)] = -1
                    at = gain.argmax(1)
                    top = gain[np.arange(width), at]
                    better = top > best
                    best[better] = top[better]
                    feature[first : first + width][better] = f
                    cut[first : first + width][better] = q[at[better]]
                node = node * 2 + (x[np.arange(len(y)), feature[first + node]] > cut[first + node])
            g, h = np.bincount(node, grad, 2**self.depth), np.bincount(node, hess, 2**self.depth)
            leaf = self.rate * g / (h + self.l2)
            self.trees.append((feature, cut, leaf))
            score = score + leaf[node]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                at = 2**level - 1 + node
                node = node * 2 + (x[rows, feature[at]] > cut[at])
            score += leaf[node]
        return sigmoid(score)
