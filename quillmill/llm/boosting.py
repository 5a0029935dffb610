"""Small histogram gradient-boosted trees in NumPy, and Platt calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class BoostedTrees:
    """Binary classifier: depth-limited trees on binned features, logistic loss, calibrated afterwards."""

    rounds: int = 40
    depth: int = 3
    bins: int = 32
    rate: float = 0.2
    penalty: float = 1.0
    least: float = 1.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[dict[int, tuple[int, int, float]]] = field(default_factory=list)
    base: float = 0.0
    slope: float = 1.0
    shift: float = 0.0

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        x, y = np.nan_to_num(np.asarray(x, float)), np.asarray(y, float)
        inner = np.linspace(0, 1, self.bins + 1)[1:-1]
        # Quantiles where the rows are, even steps where few are: a rare value between two crowds gets its own bins.
        self.edges = [np.unique(np.concatenate([np.quantile(v, inner), v.min() + (v.max() - v.min()) * inner])) for v in x.T]
        b = self._binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = _sigmoid(score)
            tree: dict[int, tuple[int, int, float]] = {}
            score += self._grow(tree, 1, b, y - p, p * (1 - p), np.arange(len(y)), len(y))
            self.trees.append(tree)
        return self

    def _grow(self, tree: dict, node: int, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(n)
        best = (1e-6, -1, 0)
        gs, hs = g[rows].sum(), h[rows].sum()
        if node < 1 << self.depth:
            for j in range(b.shape[1]):
                size = len(self.edges[j]) + 1
                cg = np.cumsum(np.bincount(b[rows, j], g[rows], size))[:-1]
                ch = np.cumsum(np.bincount(b[rows, j], h[rows], size))[:-1]
                gain = cg**2 / (ch + self.penalty) + (gs - cg) ** 2 / (hs - ch + self.penalty) - gs**2 / (hs + self.penalty)
                gain[(ch < self.least) | (hs - ch < self.least)] = 0
                if len(gain) and gain.max() > best[0]:
                    # Edges between the same two rows are equally good: the middle one is kept.
                    equal = np.nonzero(gain >= gain.max() * (1 - 1e-9))[0]
                    best = (float(gain.max()), j, int(equal[len(equal) // 2]))
        if best[1] < 0:
            value = self.rate * gs / (hs + self.penalty)
            tree[node] = (-1, 0, float(value))
            out[rows] = value
            return out
        tree[node] = (best[1], best[2], 0.0)
        left = b[rows, best[1]] <= best[2]
        out += self._grow(tree, 2 * node, b, g, h, rows[left], n)
        out += self._grow(tree, 2 * node + 1, b, g, h, rows[~left], n)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(np.nan_to_num(np.asarray(x, float)))
        total = np.full(len(b), self.base)
        for tree in self.trees:
            stack = [(1, np.arange(len(b)))]
            while stack:
                node, rows = stack.pop()
                feature, edge, value = tree[node]
                if feature < 0:
                    total[rows] += value
                    continue
                left = b[rows, feature] <= edge
                stack += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
        return total

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Platt scaling on a holdout, with targets softened by its size."""
        s, y = self.score(x), np.asarray(y, float)
        pos, neg = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        at, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])

        def loss(v: np.ndarray) -> float:
            z = v[0] * s + v[1]
            return float((np.logaddexp(0, z) - target * z).sum() + 0.005 * ((v - prior) ** 2).sum())

        for _ in range(steps):
            p = _sigmoid(at[0] * s + at[1])
            w = p * (1 - p) + 1e-9
            grad = np.array([((p - target) * s).sum(), (p - target).sum()]) + 0.01 * (at - prior)
            hess = np.array([[(w * s * s).sum(), (w * s).sum()], [(w * s).sum(), w.sum()]]) + 0.01 * np.eye(2)
            move, size = np.linalg.solve(hess, grad), 1.0
            # A full Newton step may overshoot where the classes are far apart: it is halved until the loss falls.
            while size > 1e-6 and loss(at - size * move) > loss(at):
                size /= 2
            at = at - size * move
            if size * np.abs(move).max() < 1e-9:
                break
        a, c = max(at[0], 0.05), at[1]
        self.slope, self.shift = float(a), float(c)
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.score(x) + self.shift) if len(x) else np.zeros(0)
