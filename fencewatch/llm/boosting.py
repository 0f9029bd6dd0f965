"""Gradient-boosted trees for a yes or no question, in numpy: binned features, logistic loss."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """Complete binary trees as arrays: (trees, inner nodes) of feature and border, (trees, leaves) of value."""

    start: float
    feature: np.ndarray
    border: np.ndarray
    value: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = int(np.log2(self.value.shape[1]))
        for feature, border, value in zip(self.feature, self.border, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > border[node])
            out += value[node - (2**depth - 1)]
        return out


def boosted(
    x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, least: float = 5.0
) -> BoostedTrees:
    """Fit to rows ``x`` with answers ``y`` (0 or 1); each leaf needs ``least`` rows' worth of curvature."""
    n, width = x.shape
    borders = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(borders[f], x[:, f], side="left") for f in range(width)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    inner, leaves = 2**depth - 1, 2**depth
    features, cuts, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, curve = y - p, p * (1 - p) + 1e-6
        feature, cut, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            best = np.full(count, 1e-6)
            local = node - first
            sums = [np.bincount(local, w, count) for w in (slope, curve)]
            base = sums[0] ** 2 / (sums[1] + 1)
            for f in range(width):
                size = len(borders[f]) + 1
                cell = local * size + binned[:, f]
                g = np.bincount(cell, slope, count * size).reshape(count, size).cumsum(1)[:, :-1]
                h = np.bincount(cell, curve, count * size).reshape(count, size).cumsum(1)[:, :-1]
                rest_g, rest_h = sums[0][:, None] - g, sums[1][:, None] - h
                gain = g**2 / (h + 1) + rest_g**2 / (rest_h + 1) - base[:, None]
                gain[(h < least / 4) | (rest_h < least / 4)] = 0
                if gain.shape[1]:
                    at = gain.argmax(1)
                    better = gain[np.arange(count), at] > best
                    best[better] = gain[np.arange(count), at][better]
                    feature[first : first + count][better] = f
                    cut[first : first + count][better] = borders[f][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, slope, leaves) / (np.bincount(leaf, curve, leaves) + 1)
        score += value[leaf]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return BoostedTrees(start, np.array(features), np.array(cuts), np.array(values))
