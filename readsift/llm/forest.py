"""A random forest for two classes on a bounded table of features: gini splits, bootstrap rows, a root of the features per split."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 at a leaf), threshold, children, share of positives."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    share: np.ndarray
    roots: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Mean share of positives over the trees, per row."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                inner = self.feature[at] >= 0
                if not inner.any():
                    break
                r, n = rows[inner], at[inner]
                at[inner] = self.child[n, (x[r, self.feature[n]] > self.threshold[n]).astype(int)]
            total += self.share[at]
        return total / max(1, len(self.roots))


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, leaf: int):
    best = (0.0, -1, 0.0)
    n, positive = len(y), y.sum()
    parent = positive * (n - positive) / n
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, left = x[order, f], np.cumsum(y[order])[:-1]
        size = np.arange(1, n)
        impure = left * (size - left) / size + (positive - left) * (n - size - positive + left) / (n - size)
        impure[(v[1:] == v[:-1]) | (size < leaf) | (n - size < leaf)] = np.inf
        i = int(impure.argmin()) if n > 1 else 0
        if n > 1 and parent - impure[i] > best[0] + 1e-12:
            best = (parent - impure[i], int(f), (v[i] + v[i + 1]) / 2)
    return best


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 12, leaf: int = 2, seed: int = 0) -> Forest:
    """The forest of features ``x`` and labels ``y`` (0 or 1); the same for the same arguments."""
    r = np.random.default_rng(seed)
    feature, threshold, child, share, roots = [], [], [], [], []

    def grow(rows: np.ndarray, left: int) -> int:
        at = len(feature)
        feature.append(-1)
        threshold.append(0.0)
        child.append([at, at])
        share.append(float(y[rows].mean()))
        if left and 0 < share[at] < 1:
            some = r.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False)
            gain, f, t = _split(x[rows], y[rows], some, leaf)
            if f >= 0:
                feature[at], threshold[at] = f, t
                over = x[rows, f] > t
                child[at] = [grow(rows[~over], left - 1), grow(rows[over], left - 1)]
        return at

    for _ in range(trees if len(y) else 0):
        roots.append(grow(r.integers(0, len(y), len(y)), depth))
    return Forest(np.array(feature, int), np.array(threshold), np.array(child, int).reshape(-1, 2), np.array(share), np.array(roots, int))
