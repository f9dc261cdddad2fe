"""A small random forest on binned features, in numpy, for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


class Forest:
    """Trees grown on bootstrap samples with a few random features a node; a leaf keeps the classes' shares."""

    def __init__(self, trees: int = 12, depth: int = 9, bins: int = 32, least: int = 5, seed: int = 7):
        self.trees, self.depth, self.bins, self.least, self.seed = trees, depth, bins, least, seed

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int) -> Forest:
        rng = np.random.default_rng(self.seed)
        self.classes = classes
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        self.nodes = [self._grow(b, y, rng.integers(0, len(y), len(y)), rng) for _ in range(self.trees)]
        return self

    def _grow(self, b: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
        """Nodes (feature, bin, left, right, shares); feature -1 marks a leaf."""
        nodes: list[tuple] = [()]
        open_ = [(0, rows, 0)]
        tries = max(2, int(np.sqrt(b.shape[1])) + 1)
        while open_:
            at, rows, depth = open_.pop()
            counts = np.bincount(y[rows], minlength=self.classes)
            best = (1e-9, -1, 0)
            if depth < self.depth and len(rows) >= 2 * self.least and counts.max() < len(rows):
                whole = (counts**2).sum() / len(rows)
                for j in rng.permutation(b.shape[1])[:tries]:
                    table = np.bincount(b[rows, j] * self.classes + y[rows], minlength=self.bins * self.classes)[: self.bins * self.classes].reshape(self.bins, -1).cumsum(0)
                    n = table.sum(1)
                    ok = (n >= self.least) & (len(rows) - n >= self.least)
                    gain = np.where(ok, (table**2).sum(1) / np.maximum(n, 1) + ((counts - table) ** 2).sum(1) / np.maximum(len(rows) - n, 1) - whole, 0)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), int(j), k)
            if best[1] < 0:
                nodes[at] = (-1, 0, 0, 0, counts / max(1, len(rows)))
                continue
            left = b[rows, best[1]] <= best[2]
            nodes[at] = (best[1], best[2], len(nodes), len(nodes) + 1, None)
            nodes += [(), ()]
            open_ += [(len(nodes) - 2, rows[left], depth + 1), (len(nodes) - 1, rows[~left], depth + 1)]
        return nodes

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The classes' chances of each row: the mean of the trees' shares."""
        b = self._binned(x)
        out = np.zeros((len(x), self.classes))
        for nodes in self.nodes:
            feature, cut, left, right = (np.array([n[i] for n in nodes]) for i in range(4))
            shares = np.array([n[4] if n[0] < 0 else np.zeros(self.classes) for n in nodes])
            at = np.zeros(len(x), int)
            while (inner := feature[at] >= 0).any():
                go = b[np.arange(len(x)), np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += shares[at]
        return out / max(1, len(self.nodes))


def isotonic(right: np.ndarray, n: np.ndarray) -> list[float]:
    """Shares of right answers over bins in order, made non-decreasing by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for r, k in zip(right, n, strict=True):
        blocks.append([float(r), float(k), 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            r2, k2, w2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + r2, blocks[-1][1] + k2, blocks[-1][2] + w2]
    return [r / max(k, 1) for r, k, w in blocks for _ in range(int(w))]
