"""Histogram gradient-boosted trees in numpy, flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """All trees in flat arrays: node i tests ``x[feature[i]] <= threshold[i]``; a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for the rows of ``x``; every step moves all rows in all trees at once."""
        out = np.empty(len(x))
        for s in range(0, len(x), 2_000):
            part = x[s : s + 2_000]
            rows = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                right = part[rows, self.feature[node]] > self.threshold[node]
                node = np.where(right, self.right[node], self.left[node])
            out[s : s + 2_000] = self.base + self.value[node].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def train(
    x: np.ndarray,
    y: np.ndarray,
    weight: np.ndarray | None = None,
    trees: int = 80,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    l2: float = 1.0,
    least: int = 10,
) -> Forest:
    """Fit log loss for labels 0 and 1.

    Features are cut into at most ``bins`` quantile bins; a level of a tree
    sums gradients by (node, feature, bin) and takes the best split of each node.
    """
    n, m = x.shape
    weight = np.ones(n) if weight is None else weight
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], axis=1)
    p = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
    base = float(np.log(p / (1 - p)))
    margin = np.full(n, base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        i = len(feature)
        feature.append(0)
        threshold.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(v)
        return i

    flat = binned + np.arange(m) * bins
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = weight * (prob - y), weight * prob * (1 - prob)
        root = add(-rate * g.sum() / (h.sum() + l2))
        roots.append(root)
        node = np.full(n, root)
        open_ = [root]
        for _level in range(depth):
            nxt = []
            for k in open_:
                rows = np.flatnonzero(node == k)
                if len(rows) < 2 * least:
                    continue
                where = flat[rows].ravel()
                sums = [np.bincount(where, np.repeat(v[rows], m), m * bins).reshape(m, bins).cumsum(axis=1) for v in (g, h, np.ones(n))]
                gl, hl, nl = sums
                gt, ht, nt = gl[:, -1:], hl[:, -1:], nl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(nl < least) | (nt - nl < least)] = -1
                best = int(gain.argmax())
                f, b = divmod(best, bins)
                if gain.flat[best] <= 1e-9 or b >= len(cuts[f]):
                    continue
                goes_left = binned[rows, f] <= b
                for side, mine in ((left, rows[goes_left]), (right, rows[~goes_left])):
                    child = add(-rate * g[mine].sum() / (h[mine].sum() + l2))
                    side[k] = child
                    node[mine] = child
                    nxt.append(child)
                feature[k], threshold[k], value[k] = f, float(cuts[f][b]), 0.0
            open_ = nxt
        margin += np.asarray(value)[node]
    return Forest(*(np.asarray(v) for v in (feature, threshold, left, right, value)), np.asarray(roots), depth, base)
