"""Gradient-boosted trees for two classes and isotonic calibration, in numpy, for tables that fit a task."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Complete binary trees over binned features; a row goes right where its bin exceeds the node's."""

    edges: list[np.ndarray]
    base: float = 0.0
    depth: int = 3
    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1).astype(np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, split, leaf in zip(self.feature, self.split, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > split[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms; least: hessian that a child must keep."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(edges, float(np.log(p / (1 - p))), depth)
    b, m = model.binned(x), np.full(len(x), model.base)
    width = bins + 1
    for _ in range(trees if len(np.unique(y)) > 1 else 0):
        q = 1 / (1 + np.exp(-m))
        g, h = q - y, q * (1 - q)
        feature, split = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first = 2**level - 1
            local = node - first
            best = np.full(2**level, 1e-9)
            for j in range(x.shape[1]):
                key = local * width + b[:, j]
                gs = np.bincount(key, g, 2**level * width).reshape(-1, width).cumsum(1)
                hs = np.bincount(key, h, 2**level * width).reshape(-1, width).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(2**level), at]
                better = top > best
                best[better] = top[better]
                feature[first : first + 2**level][better] = j
                split[first : first + 2**level][better] = at[better]
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > split[node])
        local = node - (2**depth - 1)
        leaf = -rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        m += leaf[local]
        model.feature.append(feature)
        model.split.append(split)
        model.leaf.append(leaf)
    return model


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, probability) of the non-decreasing least-squares fit: pool adjacent violators."""
    order = np.argsort(score, kind="stable")
    at: list[list[float]] = []  # mean, weight, lowest and highest score of a block
    for s, v in zip(score[order], y[order], strict=True):
        at.append([float(v), 1.0, float(s), float(s)])
        while len(at) > 1 and (at[-2][0] >= at[-1][0] or at[-2][3] == at[-1][2]):
            v2, w2, _, hi = at.pop()
            v1, w1, lo, _ = at.pop()
            at.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    if not at:
        return np.array([0.0]), np.array([0.5])
    # half a row of each class keeps the ends off 0 and 1
    p = [(b[0] * b[1] + 0.5) / (b[1] + 1) if len(at) > 1 else b[0] for b in at]
    knots = [(s, v) for b, v in zip(at, np.maximum.accumulate(p), strict=True) for s in {b[2], b[3]}]
    knots.sort()
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def calibrated(score: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Interpolated probability; a trace of the score keeps order among rows of one block."""
    p = np.interp(score, *knots)
    return np.clip(p * (1 - 2e-6) + 2e-6 / (1 + np.exp(-score)), 0.0, 1.0)
