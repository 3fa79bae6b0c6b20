"""Gradient-boosted regression trees for two classes, on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    rounds: int = 80
    depth: int = 4
    rate: float = 0.2
    bins: int = 32
    ridge: float = 1.0
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    #: Per tree: feature and bin of each inner node in heap order, and the leaves' values.
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    @classmethod
    def of(cls, saved: dict) -> BoostedTrees:
        """From what ``saved`` gave."""
        trees = [(np.array(f), np.array(c), np.array(v)) for f, c, v in saved["trees"]]
        return cls(depth=saved["depth"], bins=saved["bins"], start=saved["start"], edges=[np.array(e) for e in saved["edges"]], trees=trees)

    def saved(self) -> dict:
        rounded = [[f.tolist(), c.tolist(), [round(float(x), 5) for x in v]] for f, c, v in self.trees]
        return {"depth": self.depth, "bins": self.bins, "start": round(self.start, 5), "edges": [[float(x) for x in e] for e in self.edges], "trees": rounded}

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)]).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> BoostedTrees:
        """Logistic loss, second-order gains, trees grown level by level."""
        w = np.ones(len(y)) if weight is None else weight
        grid = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, k], grid)) for k in range(x.shape[1])]
        b = self._binned(x)
        share = np.average(y, weights=w)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
            feature, cut, leaf, at = self._grow(b, g, h)
            self.trees.append((feature, cut, leaf))
            score += leaf[at]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        inner = (1 << self.depth) - 1
        feature, cut = np.zeros(inner, dtype=np.int64), np.full(inner, self.bins, dtype=np.int64)
        node = np.zeros(len(g), dtype=np.int64)
        for level in range(self.depth):
            width, base = 1 << level, (1 << level) - 1
            gs, hs = np.bincount(node, g, width), np.bincount(node, h, width)
            best = np.full(width, 1e-9)
            for k in range(b.shape[1]):
                cell = node * (self.bins + 1) + b[:, k]
                gl = np.bincount(cell, g, width * (self.bins + 1)).reshape(width, -1).cumsum(axis=1)
                hl = np.bincount(cell, h, width * (self.bins + 1)).reshape(width, -1).cumsum(axis=1)
                gr, hr = gs[:, None] - gl, hs[:, None] - hl
                gain = gl**2 / (hl + self.ridge) + gr**2 / (hr + self.ridge) - (gs**2 / (hs + self.ridge))[:, None]
                at = gain.argmax(axis=1)
                better = gain[np.arange(width), at] > best
                best = np.where(better, gain[np.arange(width), at], best)
                feature[base : base + width] = np.where(better, k, feature[base : base + width])
                cut[base : base + width] = np.where(better, at, cut[base : base + width])
            f, c = feature[base + node], cut[base + node]
            node = 2 * node + (b[np.arange(len(g)), f] > c)
        leaves = 1 << self.depth
        leaf = -self.rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + self.ridge)
        return feature, cut, leaf, node

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                base = (1 << level) - 1
                node = 2 * node + (b[rows, feature[base + node]] > cut[base + node])
            out += leaf[node]
        return out
