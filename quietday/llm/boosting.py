"""Gradient-boosted trees for a yes/no label: histogram splits, logistic loss, NumPy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees of one depth as heaps: split feature and bin for each inner node, value for each leaf."""

    edges: list[np.ndarray]
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label for each row."""
        b, rows = self.binned(x), np.arange(len(x))
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.values.shape[1]))
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            total += value[node - (len(value) - 1)]
        return 1 / (1 + np.exp(-total))


def edges_of(values: np.ndarray) -> np.ndarray:
    """Where bins begin: at each value but the least, or at quantiles if there are many values."""
    distinct = np.unique(values)
    return distinct[1:] if len(distinct) <= BINS else np.unique(np.quantile(values, np.linspace(0, 1, BINS + 1)[1:-1]))


def train(x: np.ndarray, y: np.ndarray, rounds: int = 50, depth: int = 4, rate: float = 0.25, least: float = 5.0, ridge: float = 1.0) -> Trees:
    n, k = x.shape
    edges = [edges_of(x[:, j]) for j in range(k)]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    trees = Trees(edges, np.zeros((rounds, (1 << depth) - 1), np.int64), np.full((rounds, (1 << depth) - 1), 255), np.zeros((rounds, 1 << depth)), float(np.log(share / (1 - share))))
    b = trees.binned(x).astype(np.int64)
    yes_no = [j for j in range(k) if len(edges[j]) == 1]
    flags, many = b[:, yes_no].astype(float), [j for j in range(k) if len(edges[j]) > 1]
    margin = np.full(n, trees.base)
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            own = node - first
            best = np.full(count, 1e-6)
            here = (own[None, :] == np.arange(count)[:, None]).astype(float)
            sums = [here @ np.column_stack([v, (1 - flags) * v[:, None]]) for v in (g, h)]  # all rows, then those below the only edge
            gt, ht = (v[:, :1] for v in sums)

            def consider(gs: np.ndarray, hs: np.ndarray, j: int) -> None:
                """Sums of the rows up to each edge of feature j."""
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                cut = gain.argmax(1)
                top = gain[np.arange(count), cut]
                better = top > best
                best[better] = top[better]
                trees.features[r, first : first + count][better] = j
                trees.cuts[r, first : first + count][better] = cut[better]

            for i, j in enumerate(yes_no):
                consider(sums[0][:, i + 1 : i + 2], sums[1][:, i + 1 : i + 2], j)
            for j in many:
                bins = len(edges[j]) + 1
                at = own * bins + b[:, j]
                consider(*(np.bincount(at, v, count * bins).reshape(count, bins).cumsum(1) for v in (g, h)), j)
            node = 2 * node + 1 + (b[np.arange(n), trees.features[r, node]] > trees.cuts[r, node])
        leaf = node - ((1 << depth) - 1)
        value = rate * np.bincount(leaf, g, 1 << depth) / (np.bincount(leaf, h, 1 << depth) + ridge)
        trees.values[r] = value
        margin += value[leaf]
    return trees
