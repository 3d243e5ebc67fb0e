"""Small numpy models fitted on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p) - np.log1p(-p)


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 300, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; ``y`` may hold probabilities."""
    n, d = x.shape
    weight = np.ones(n) if weight is None else weight
    scale = weight.sum()
    mean = np.clip((weight * y).sum() / scale, 1e-6, 1 - 1e-6)
    w, b = np.zeros(d), float(logit(mean))
    v, c, t = w.copy(), b, 1.0
    power = np.ones(d) / np.sqrt(d)
    for _ in range(12):  # the largest eigenvalue bounds the step
        power = x.T @ (x @ power)
        power /= np.linalg.norm(power) + 1e-12
    step = 1.0 / (0.25 * (np.linalg.norm(x @ power) ** 2 / n + 1.0) + l2 / n)
    for _ in range(steps):
        err = weight * (sigmoid(x @ v + c) - y)
        w2, b2 = v - step * (x.T @ err / scale + l2 * v / n), c - step * err.sum() / scale
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return w, float(b)


def auc(y: np.ndarray, score: np.ndarray) -> float:
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    s = score[order]
    first = np.r_[True, s[1:] != s[:-1]]
    group = np.cumsum(first) - 1
    starts = np.flatnonzero(first)
    ends = np.r_[starts[1:], len(s)]
    ranks[order] = ((starts + ends + 1) / 2)[group]
    pos = y == 1
    n1, n0 = pos.sum(), (~pos).sum()
    return float((ranks[pos].sum() - n1 * (n1 + 1) / 2) / max(n1 * n0, 1))
