"""Gradient-boosted trees on dense features with isotonic calibration, in numpy.

For fits on the driver over a bounded number of labelled rows; the fitted model is a small table
of splits that scores any number of rows in Arrow batches. Features are put into at most STEPS
bins once; each level of a tree is chosen from one histogram of (node, feature, bin).
"""

from __future__ import annotations

import numpy as np

DEPTH, STEPS = 3, 32


def bin_cuts(x: np.ndarray) -> np.ndarray:
    """(features, STEPS) ascending cut values: quantiles of each feature's distinct values, filled up with infinity."""
    cuts = np.full((x.shape[1], STEPS), np.inf)
    for j in range(x.shape[1] if len(x) else 0):
        values = np.unique(x[:, j])[:-1]
        if len(values) > STEPS:
            values = np.unique(values[np.linspace(0, len(values) - 1, STEPS).astype(int)])
        cuts[j, : len(values)] = values
    return cuts


def binned(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Number of cuts below each value (0 .. STEPS)."""
    return np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(x.shape[1])], axis=1)


def fit_trees(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, rate: float = 0.2, l2: float = 2.0, least: float | None = None) -> dict:
    """Logistic boosting; returns {"bias", "feature", "cut", "leaf"}: a row for each tree, its inner nodes in level order.

    least: weight on either side of a split; by default 4, or 0.4 % of all where that is more.
    """
    n, k = x.shape
    least = max(4.0, 0.004 * float(weight.sum())) if least is None else least
    p0 = float(np.clip((weight * y).sum() / max(weight.sum(), 1e-9), 1e-3, 1 - 1e-3))
    bias = float(np.log(p0 / (1 - p0)))
    cuts = bin_cuts(x)
    at = binned(x, cuts) + np.arange(k) * (STEPS + 1)
    score, inner = np.full(n, bias), 2**DEPTH - 1
    features, limits, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        feature, limit = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf)
        place = np.zeros(n, dtype=np.int64)
        for level in range(DEPTH):
            nodes, first = 2**level, 2**level - 1
            slot = (at + ((place - first) * (k * (STEPS + 1)))[:, None]).ravel()
            shape = (nodes, k, STEPS + 1)
            gl, hl, nl = (np.bincount(slot, weights=np.repeat(v, k), minlength=nodes * k * (STEPS + 1)).reshape(shape).cumsum(axis=2) for v in (g, h, weight))
            gt, ht, nt = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
            gain[(nl < least) | (nt - nl < least)] = -1
            gain = gain[:, :, :STEPS].reshape(nodes, -1)
            best = gain.argmax(axis=1)
            good = gain[np.arange(nodes), best] > 1e-9
            feature[first : first + nodes] = np.where(good, best // STEPS, 0)
            limit[first : first + nodes] = np.where(good, cuts[best // STEPS, best % STEPS], np.inf)
            place = 2 * place + 1 + (x[np.arange(n), feature[place]] > limit[place])
        leaf = place - inner
        value = -rate * np.bincount(leaf, weights=g, minlength=inner + 1) / (np.bincount(leaf, weights=h, minlength=inner + 1) + l2)
        features.append(feature)
        limits.append(limit)
        leaves.append(value)
        score = score + value[leaf]
    return {"bias": bias, "feature": np.array(features), "cut": np.array(limits), "leaf": np.array(leaves)}


def tree_score(model: dict, x: np.ndarray) -> np.ndarray:
    out, rows = np.full(len(x), model["bias"]), np.arange(len(x))
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        node = np.zeros(len(x), dtype=np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
        out += leaf[node - (2**DEPTH - 1)]
    return out


def fit_isotonic(score: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Pool-adjacent-violators: steps (from score, probability), ascending."""
    order = np.argsort(score, kind="stable")
    blocks: list = []
    for s, t, w in zip(score[order], y[order], weight[order]):
        if blocks and blocks[-1][0] == s:
            lo, total, mass = blocks.pop()
            blocks.append((lo, total + t * w, mass + w))
        else:
            blocks.append((s, t * w, w))
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            (lo, a, m), (_, b, n) = blocks[-2], blocks[-1]
            blocks[-2:] = [(lo, a + b, m + n)]
    return np.array([b[0] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def calibrated(steps, score: np.ndarray) -> np.ndarray:
    """Probability of each score: that of the step it lies on, the lowest one below them all."""
    lo, p = steps
    return p[np.maximum(np.searchsorted(lo, score, side="right") - 1, 0)] if len(lo) else np.zeros(len(score))


def fit_calibrated(x: np.ndarray, y: np.ndarray, weight: np.ndarray, folds: int = 5) -> dict:
    """Trees on all rows, calibrated on out-of-fold scores."""
    part = np.arange(len(y)) % folds
    out = np.zeros(len(y))
    for k in range(folds):
        held, rest = part == k, part != k
        if held.any() and rest.any():
            out[held] = tree_score(fit_trees(x[rest], y[rest], weight[rest]), x[held])
    return {"trees": fit_trees(x, y, weight), "steps": fit_isotonic(out, y, weight)}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    return calibrated(model["steps"], tree_score(model["trees"], x))
