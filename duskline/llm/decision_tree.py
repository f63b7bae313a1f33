"""A small decision tree: splits on one feature, chosen by Gini impurity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Node:
    value: float
    feature: int = -1
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def fit(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 2) -> Node:
    """Grows a tree; `least` rows on each side of a split. Ties go to the first feature."""
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or node.value in (0.0, 1.0):
        return node
    best = 2 * node.value * (1 - node.value) * len(y) - 1e-9
    for feature in range(x.shape[1]):
        order = np.argsort(x[:, feature], kind="stable")
        values, labels = x[order, feature], y[order]
        ones, n = np.cumsum(labels)[:-1], np.arange(1, len(y))
        left, right = ones / n, (labels.sum() - ones) / (len(y) - n)
        cost = 2 * left * (1 - left) * n + 2 * right * (1 - right) * (len(y) - n)
        valid = (values[1:] > values[:-1]) & (n >= least) & (len(y) - n >= least)
        if valid.any():
            at = int(np.argmin(np.where(valid, cost, np.inf)))
            if cost[at] < best:
                best = cost[at]
                node.feature, node.threshold = feature, float((values[at] + values[at + 1]) / 2)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.threshold
        node.low = fit(x[low], y[low], depth - 1, least)
        node.high = fit(x[~low], y[~low], depth - 1, least)
    return node


def predict(node: Node, row: list[float]) -> float:
    """Share of label 1 in the leaf that a row reaches."""
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.threshold else node.high
    return node.value
