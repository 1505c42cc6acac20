"""Sparse logistic regression in numpy, and calibration of scores."""

from __future__ import annotations

import numpy as np


BLOCK = 1 << 20  # entries that are worked on at once


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scores(weight: np.ndarray, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Linear scores of n rows given as (row, feature, value) entries; the last weight is the bias."""
    w, out = weight.astype(np.float32), np.full(n, float(weight[-1]))
    for a in range(0, len(row), BLOCK):
        at = slice(a, a + BLOCK)
        out += np.bincount(row[at], w[feature[at]] * value[at], n)
    return out


def fit(row: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray, dim: int, sample_weight: np.ndarray | None = None, rounds: int = 150, rate: float = 0.3, l2: float = 1e-4) -> np.ndarray:
    """Weights (dim + 1) by full-batch Adam on soft labels y."""
    n = len(y)
    w, m, v = np.zeros(dim + 1), np.zeros(dim + 1), np.zeros(dim + 1)
    if not n:
        return w
    sw = np.ones(n) if sample_weight is None else sample_weight
    sw = sw / sw.sum()
    for t in range(1, rounds + 1):
        e = (sigmoid(scores(w, row, feature, value, n)) - y) * sw
        e32, g = e.astype(np.float32), np.append(np.zeros(dim), e.sum())
        for a in range(0, len(row), BLOCK):
            at = slice(a, a + BLOCK)
            g[:-1] += np.bincount(feature[at], e32[row[at]] * value[at], dim)
        g[:-1] += l2 * w[:-1]
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (1 - t / (rounds + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def platt(score: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a * score + b), by Newton steps; a >= 0."""
    if not len(y):
        return 1.0, 0.0
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 0.0, float(np.log((n1 + 1) / (n0 + 1)))
    for _ in range(rounds):
        p = sigmoid(a * score + b)
        g = np.array([((p - target) * score).sum(), (p - target).sum()])
        d = p * (1 - p) + 1e-9
        h = np.array([[(d * score * score).sum() + 1e-3, (d * score).sum()], [(d * score).sum(), d.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - float(step[0]), b - float(step[1])
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 0.0), b
