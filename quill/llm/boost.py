"""Small gradient-boosted trees for a bounded training sample: logistic loss, quantile bins."""

from __future__ import annotations

import numpy as np


class Boost:
    """Binary classifier; ``fit`` takes at most some thousand rows, ``score`` any number."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16) -> None:
        self.trees, self.depth, self.rate, self.bins = trees, depth, rate, bins
        self.edges: list[np.ndarray] = []
        self.forest: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boost:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        raw = np.full(len(y), self.base)
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-raw))
            tree = self._grow(b, y - prob, prob * (1 - prob))
            self.forest.append(tree)
            raw += self._apply(tree, b)
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A complete binary tree in heap order: feature, bin and, at the leaves, value."""
        inner, width = 2 ** self.depth - 1, int(b.max()) + 2
        feature, cut, value = np.zeros(inner, int), np.full(inner, width), np.zeros(2 ** self.depth)
        at = np.zeros(len(g), int)
        for node in range(inner):
            rows = at == node
            if rows.sum() >= 4:
                gains = [self._split(b[rows, j], g[rows], h[rows], width) for j in range(b.shape[1])]
                j = int(np.argmax([s for s, _ in gains]))
                if gains[j][0] > 1e-6:
                    feature[node], cut[node] = j, gains[j][1]
            right = b[rows, feature[node]] > cut[node]
            at[rows] = 2 * node + 1 + right
        leaf = at - inner
        for k in range(2 ** self.depth):
            rows = leaf == k
            value[k] = self.rate * g[rows].sum() / (h[rows].sum() + 1.0)
        return feature, cut, value

    @staticmethod
    def _split(b: np.ndarray, g: np.ndarray, h: np.ndarray, width: int) -> tuple[float, int]:
        gs, hs = np.cumsum(np.bincount(b, g, width)), np.cumsum(np.bincount(b, h, width))
        gain = gs ** 2 / (hs + 1) + (gs[-1] - gs) ** 2 / (hs[-1] - hs + 1) - gs[-1] ** 2 / (hs[-1] + 1)
        k = int(np.argmax(gain[:-1]))
        return float(gain[k]), k

    def _apply(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        at = np.zeros(len(b), int)
        for _ in range(self.depth):
            at = 2 * at + 1 + (b[np.arange(len(b)), feature[at]] > cut[at])
        return value[at - len(feature)]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of the positive class."""
        b = self._binned(x)
        raw = np.full(len(x), self.base)
        for tree in self.forest:
            raw += self._apply(tree, b)
        return 1 / (1 + np.exp(-raw))


def calibrated_threshold(score: np.ndarray, truth: np.ndarray, precision: float) -> float:
    """The lowest score from which on held-out rows have at least ``precision``; above 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    s, hit = score[order], np.cumsum(truth[order])
    good = hit / np.arange(1, len(s) + 1) >= precision
    last = np.ones(len(s), bool)
    last[:-1] = s[1:] != s[:-1]  # equal scores stand or fall together
    ok = np.flatnonzero(good & last)
    return float(s[ok[-1]]) if len(ok) else 2.0
