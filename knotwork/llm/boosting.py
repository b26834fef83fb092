"""Gradient-boosted trees on binary labels, in numpy, with Platt calibration."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Depth-limited trees on binned features, fitted to the logistic loss.

    A tree is an array of nodes (feature, threshold, left, right, value); a leaf has feature -1."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 24, least: int = 8):
        self.n, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.trees: list[np.ndarray] = []
        self.base, self.a, self.b = 0.0, 1.0, 0.0

    def _grow(self, x, g, h, cuts) -> np.ndarray:
        nodes: list[list[float]] = []

        def node(rows, level):
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, g[rows].sum() / (h[rows].sum() + 1.0)])
            best = (1e-6, -1, 0.0)
            if level < self.depth and len(rows) >= 2 * self.least:
                whole = g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
                for f, own in enumerate(cuts):
                    if not len(own):
                        continue
                    k = np.searchsorted(own, x[rows, f], "left")
                    gs, hs, ns = (np.bincount(k, w, len(own) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None))
                    gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                    gain[(ns < self.least) | (len(rows) - ns < self.least)] = -1
                    j = int(gain.argmax())
                    if gain[j] > best[0]:
                        best = (gain[j], f, own[j])
            if best[1] >= 0:
                side = x[rows, best[1]] <= best[2]
                nodes[me][:2] = best[1], best[2]
                nodes[me][2] = node(rows[side], level + 1)
                nodes[me][3] = node(rows[~side], level + 1)
            return me

        node(np.arange(len(x)), 0)
        return np.array(nodes)

    @staticmethod
    def _walk(tree, x) -> np.ndarray:
        at = np.zeros(len(x), int)
        while True:
            f = tree[at, 0].astype(int)
            inner = f >= 0
            if not inner.any():
                return tree[at, 4]
            go = x[np.arange(len(x)), np.maximum(f, 0)] <= tree[at, 1]
            at = np.where(inner, np.where(go, tree[at, 2], tree[at, 3]), at).astype(int)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.n):
            q = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - q, q * (1 - q), cuts)
            self.trees.append(tree)
            f += self.rate * self._walk(tree, x)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for t in self.trees:
            f += self.rate * self._walk(t, x)
        return f

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> Boosted:
        """Platt scaling on rows that the trees haven't seen."""
        m = self.margin(x)
        t = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
        for _ in range(steps):
            q = 1 / (1 + np.exp(-(self.a * m + self.b)))
            w = np.maximum(q * (1 - q), 1e-6)
            hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, np.array([((t - q) * m).sum(), (t - q).sum()]))
            self.a, self.b = self.a + step[0], self.b + step[1]
            if np.abs(step).max() < 1e-8:
                break
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.margin(x) + self.b, -30, 30)))
