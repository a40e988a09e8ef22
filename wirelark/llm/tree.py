"""A small decision tree (CART, Gini) that is trained on a labelled table and applied to whole arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Node:
    p: float
    feature: int = -1
    cut: float = 0.0
    left: Node | None = None
    right: Node | None = None


def _gini(y: np.ndarray) -> float:
    p = y.mean()
    return 2 * p * (1 - p)


def fit(x: np.ndarray, y: np.ndarray, depth: int = 7, least: int = 2) -> Node:
    """Ties between splits go to the first feature and the lowest cut, so that a fit is repeatable."""
    p = float(y.mean())
    if depth == 0 or len(y) < 2 * least or p in (0.0, 1.0):
        return Node(p)
    best = (_gini(y) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ys = x[order, f], y[order]
        ones, n = np.cumsum(ys), len(ys)
        for i in np.flatnonzero(v[1:] > v[:-1]) + 1:
            if i < least or n - i < least:
                continue
            a, b = ones[i - 1] / i, (ones[-1] - ones[i - 1]) / (n - i)
            g = (2 * a * (1 - a) * i + 2 * b * (1 - b) * (n - i)) / n
            if g < best[0] - 1e-12:
                best = (g, f, (v[i] + v[i - 1]) / 2)
    if best[1] < 0:
        return Node(p)
    go = x[:, best[1]] <= best[2]
    return Node(p, best[1], best[2], fit(x[go], y[go], depth - 1, least), fit(x[~go], y[~go], depth - 1, least))


def score(node: Node, x: np.ndarray) -> np.ndarray:
    """The share of ones in the leaf of each row."""
    if node.feature < 0:
        return np.full(len(x), node.p)
    out, go = np.empty(len(x)), x[:, node.feature] <= node.cut
    out[go] = score(node.left, x[go])
    out[~go] = score(node.right, x[~go])
    return out
