"""Boosted and bagged trees over binned features, in numpy.

A level of a tree is grown for all its nodes at once from histograms of gradients by node, feature
and bin. Fitting takes a bounded sample on one machine; scoring is a vectorised function of columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """For each column (row of x) the bounds of bins of like counts."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at, method="lower")) if c.size else np.zeros(0) for c in x]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each value: how many bounds are less. Missing values count as 0."""
    return np.stack([np.searchsorted(e, np.nan_to_num(c), "left") for c, e in zip(x, edges)]).astype(np.uint8)


@dataclass
class Trees:
    """Complete binary trees as arrays by tree and node, and values by tree and leaf."""

    feature: np.ndarray
    above: np.ndarray
    value: np.ndarray

    def total(self, bins: np.ndarray) -> np.ndarray:
        """The sum of all trees' values for each row (column of bins)."""
        n = bins.shape[1]
        rows, out = np.arange(n), np.zeros(n)
        for feature, above, value in zip(self.feature, self.above, self.value):
            node = np.zeros(n, np.int64)
            while (node[:1] < len(feature)).all() and n:
                node = 2 * node + 1 + (bins[feature[node], rows] > above[node])
            out += value[node - len(feature)] if n else 0
        return out


def grow(bins: np.ndarray, gradient: np.ndarray, weight: np.ndarray, depth: int, l2: float, least: float, some: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One tree: features and bounds of its nodes, values of its leaves, and each row's leaf.

    some: the features that each level may use. A node that no split betters sends all rows left.
    """
    n = bins.shape[1]
    rows, node = np.arange(n), np.zeros(n, np.int64)
    feature, above = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, BINS, np.int64)
    for level in range(depth):
        k = 1 << level
        best, chosen, bound = np.full(k, 1e-9), np.zeros(k, np.int64), np.full(k, BINS, np.int64)
        for f in some[level]:
            cell = node * BINS + bins[f]
            g, h = (np.bincount(cell, w, k * BINS).reshape(k, BINS).cumsum(axis=1) for w in (gradient, weight))
            left, right = h[:, :-1], h[:, -1:] - h[:, :-1]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = g[:, :-1] ** 2 / (left + l2) + (g[:, -1:] - g[:, :-1]) ** 2 / (right + l2) - g[:, -1:] ** 2 / (h[:, -1:] + l2)
            gain[(left < least) | (right < least)] = 0
            at = gain.argmax(axis=1)
            top = gain[np.arange(k), at]
            better = top > best
            best[better], chosen[better], bound[better] = top[better], f, at[better]
        feature[k - 1 : 2 * k - 1], above[k - 1 : 2 * k - 1] = chosen, bound
        node = 2 * node + (bins[chosen[node], rows] > bound[node])
    g, h = np.bincount(node, gradient, 1 << depth), np.bincount(node, weight, 1 << depth)
    return feature, above, -g / np.maximum(h + l2, 1e-12), node


def _stack(trees: list) -> Trees:
    return Trees(*(np.stack(c) for c in zip(*trees)))


def boost(bins: np.ndarray, y: np.ndarray, rounds: int, depth: int, rate: float = 0.1, l2: float = 1.0) -> tuple[float, Trees]:
    """Logistic boosting by Newton steps: the base of the log odds, and the trees."""
    share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
    base, trees = np.log(share / (1 - share)), []
    score = np.full(len(y), base)
    every = [np.arange(len(bins))] * depth
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        feature, above, value, leaf = grow(bins, p - y, p * (1 - p), depth, l2, 1e-3, every)
        trees.append((feature, above, rate * value))
        score += rate * value[leaf]
    return base, _stack(trees)


def forest(bins: np.ndarray, y: np.ndarray, count: int, depth: int, seed: int) -> Trees:
    """Trees on bootstrap samples, each level over a random square root of the features; values are
    shares of positive rows, divided by the number of trees."""
    rng, trees = np.random.default_rng(seed), []
    width = max(1, round(len(bins) ** 0.5))
    for _ in range(count):
        w = rng.poisson(1.0, len(y)).astype(float)
        some = [rng.choice(len(bins), width, replace=False) for _ in range(depth)]
        feature, above, value, _ = grow(bins, -y * w, w, depth, 0.0, 1.0, some)
        trees.append((feature, above, value / count))
    return _stack(trees)
