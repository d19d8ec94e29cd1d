"""Small gradient-boosted trees for binary labels: logistic loss, trees of a set depth over few distinct values."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class BoostedTrees:
    rounds: int = 40
    depth: int = 3
    rate: float = 0.3
    least_rows: int = 5
    damping: float = 1.0
    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start, self.trees = float(np.log(share / (1 - share))), []
        # between all values where they are few, else between sixteenths of the rows
        values = [np.unique(column) for column in x.T]
        cuts = [some[:-1] if len(some) <= 17 else np.unique(np.quantile(column, np.linspace(0, 1, 17)[:-1])) for some, column in zip(values, x.T)]
        points = np.full((x.shape[1], max(1, *map(len, cuts))), np.inf)
        for row, some in zip(points, cuts):
            row[: len(some)] = some
        bins = np.stack([np.searchsorted(some, column) for some, column in zip(cuts, x.T)] + [y.astype(np.int64)], axis=1)  # cuts below the value
        rows, times = np.unique(bins, axis=0, return_counts=True)  # equal rows once
        bins, y, times = rows[:, :-1], rows[:, -1].astype(float), times.astype(float)
        margin = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            tree, leaf = self._tree(bins, (y - p) * times, p * (1 - p) * times, times, points)
            self.trees.append(tree)
            margin += self.rate * tree[2][leaf]
        return self

    def _tree(self, bins: np.ndarray, slope: np.ndarray, bend: np.ndarray, times: np.ndarray, points: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Feature and cut of each inner node, and the values of the leaves, in heap order; feature -1 goes left; and the leaf of each row.

        The nodes of a level share one histogram of rows, slopes and bends by node, feature and bin.
        """
        inner = (1 << self.depth) - 1
        feature, cut, value = np.full(inner, -1), np.zeros(inner), np.zeros(1 << self.depth)
        n_features, n_points = points.shape
        node = np.zeros(len(bins), np.int64)
        cell = np.arange(n_features) * (n_points + 1) + bins
        for level in range(self.depth):
            nodes, first = 1 << level, (1 << level) - 1
            at = (node[:, None] * (n_features * (n_points + 1)) + cell).ravel()

            def right_of_cuts(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                sums = np.bincount(at, np.repeat(weight, n_features), nodes * n_features * (n_points + 1)).reshape(nodes, n_features, n_points + 1)
                return sums[:, :, ::-1].cumsum(axis=2)[:, :, -2::-1], sums.sum(axis=2)[:, :, None]

            (n, all_n), (g, all_g), (h, all_h) = (right_of_cuts(w) for w in (times, slope, bend))
            gain = g * g / (h + self.damping) + (all_g - g) ** 2 / (all_h - h + self.damping) - all_g**2 / (all_h + self.damping)
            gain[np.minimum(n, all_n - n) < self.least_rows] = 0
            flat = gain.reshape(nodes, -1)
            best = flat.argmax(axis=1)
            split = np.flatnonzero(flat[np.arange(nodes), best] > 1e-6)
            feature[first + split], cut[first + split] = best[split] // n_points, points.ravel()[best[split]]
            place = np.full(nodes, -1)
            place[split] = best[split] % n_points
            f = np.maximum(feature[first + node], 0)
            node = 2 * node + ((place[node] >= 0) & (bins[np.arange(len(bins)), f] > place[node]))
        value = np.bincount(node, slope, len(value)) / (np.bincount(node, bend, len(value)) + self.damping)
        return (feature, cut, value), node

    def _leaf(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > cut[node]))
        return value[node - len(feature)]

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        margin = np.full(len(x), self.start)
        for tree in self.trees:
            margin += self.rate * self._leaf(tree, x)
        return 1 / (1 + np.exp(-margin))
