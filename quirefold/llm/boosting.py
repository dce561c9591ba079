"""Gradient-boosted trees on binned features, and isotonic calibration, in NumPy; for fits on a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete trees of one depth: node i has children 2i+1 and 2i+2; a row goes right where its value is above the cut."""

    base: float
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit_forest(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 1.0) -> Forest:
    prior = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(np.concatenate([c, np.unique(c)[:bins]]), np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, "left") for c, col in zip(cuts, x.T, strict=True)], 1)  # bin b: value <= cuts[b]
    raw, inner = np.full(len(x), base), 2**depth - 1
    features, thresholds, values = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(x), np.int64)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for i in range(inner):
            own = np.flatnonzero(node == i)
            best, gg, hh = 1e-6, g[own].sum(), h[own].sum()
            for j, cj in enumerate(cuts):
                if not len(own) or not len(cj):
                    continue
                gl = np.cumsum(np.bincount(binned[own, j], g[own], len(cj) + 1))[:-1]
                hl = np.cumsum(np.bincount(binned[own, j], h[own], len(cj) + 1))[:-1]
                gain = gl**2 / (hl + l2) + (gg - gl) ** 2 / (hh - hl + l2) - gg**2 / (hh + l2)
                if gain[k := int(gain.argmax())] > best:
                    best, f[i], c[i] = gain[k], j, cj[k]
            node[own] = 2 * i + 1 + (x[own, f[i]] > c[i])
        leaf = node - inner
        v = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + l2)
        raw = raw + v[leaf]
        features.append(f), thresholds.append(c), values.append(v)
    return Forest(base, np.array(features), np.array(thresholds), np.array(values), depth)


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the monotone least-squares fit (pool adjacent violators); np.interp(score, *knots) applies it."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # mean, weight, sum of scores
    for s, t in zip(score[order], y[order], strict=True):
        blocks.append([float(t), 1.0, float(s)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, q = blocks.pop()
            a = blocks[-1]
            blocks[-1] = [(a[0] * a[1] + m * w) / (a[1] + w), a[1] + w, a[2] + q]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])
