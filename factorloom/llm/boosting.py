"""Gradient-boosted trees for binary labels, small enough to train on a bounded sample, as
flat numpy node arrays for vectorised scoring. Chosen features can be constrained to act in
one direction only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees one after another. A leaf points to itself on both sides."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        margin, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            margin += self.value[node]
        return 1 / (1 + np.exp(-margin))


def train(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 2.0, min_hessian: float = 3.0) -> Trees:
    """Fit trees to rows x and labels y in {0, 1}.

    monotone[f] is 1 (the probability may only rise with feature f), -1 (only fall) or 0.
    Splits against the direction are not made, and the middle between both sides' values
    bounds all nodes below them. Rows of one class only, or none, give a constant.
    """
    mean = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(mean / (1 - mean)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])] if len(x) else []
    binned = [np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(len(y), base)

    def add() -> int:
        for nodes, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(left)), (value, 0.0)):
            nodes.append(v)
        return len(feature) - 1

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        node, g_all, h_all = add(), g[rows].sum(), h[rows].sum()
        value[node] = rate * float(np.clip(-g_all / (h_all + l2), low, high))
        best = (1e-6, -1, 0, 0.0)
        if level < depth:
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                b = binned[f][rows]
                gl, hl = (np.cumsum(np.bincount(b, v[rows], len(e) + 1))[:-1] for v in (g, h))
                gr, hr = g_all - gl, h_all - hl
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - g_all**2 / (h_all + l2)
                ok = (hl >= min_hessian) & (hr >= min_hessian) & (monotone[f] * (vr - vl) >= 0)
                gain = np.where(ok, gain, 0)
                at = int(np.argmax(gain))
                if gain[at] > best[0]:
                    best = (float(gain[at]), f, at, float(vl[at] + vr[at]) / 2)
        if best[1] >= 0:
            _, f, at, middle = best
            goes_left = binned[f][rows] <= at
            bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[monotone[f]]
            feature[node], threshold[node] = f, float(edges[f][at])
            left[node] = grow(rows[goes_left], g, h, level + 1, *bounds[0])
            right[node] = grow(rows[~goes_left], g, h, level + 1, *bounds[1])
        else:
            margin[rows] += value[node]
        return node

    if 0 < y.sum() < len(y):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    arrays = (np.array(a, k) for a, k in ((roots, np.int64), (feature, np.int64), (threshold, float), (left, np.int64), (right, np.int64), (value, float)))
    return Trees(*arrays, base, depth)
