"""Logistic regression over sparse presence features, in NumPy on the driver.

It fits on a sample whose size is a documented parameter of its callers, so
what it holds does not grow with the corpus; scoring the corpus is a Spark job.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Presence features of some rows: feature numbers in one array, row
    offsets, and the 64-bit hash of every feature number."""
    offsets: np.ndarray
    features: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(lists) -> "Rows":
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.zeros(0, np.int64)
        hashes, features, times = np.unique(flat, return_inverse=True, return_counts=True)
        # a feature of one row alone tells nothing of others
        often = times > 1
        number = np.cumsum(often, dtype=np.int32) - 1
        keep = often[features]
        owner = np.repeat(np.arange(len(size), dtype=np.int32), size)[keep]
        offsets = np.searchsorted(owner, np.arange(len(size) + 1))
        return Rows(offsets, number[features[keep]], hashes[often])

    def __len__(self):
        return len(self.offsets) - 1

    @property
    def owner(self):
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.offsets))


@dataclass
class Linear:
    """bias + sum of the weights of present features + dense part."""
    bias: float
    hashes: np.ndarray
    weights: np.ndarray
    dense: np.ndarray

    def margin(self, rows: Rows, dense: np.ndarray) -> np.ndarray:
        table = np.zeros(len(rows.hashes))
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, rows.hashes), len(self.hashes) - 1)
            table = np.where(self.hashes[at] == rows.hashes, self.weights[at], 0.0)
        sums = np.bincount(rows.owner, table[rows.features], len(rows))
        return self.bias + sums + (dense @ self.dense if dense.shape[1] else 0.0)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def informative(rows: Rows, y: np.ndarray, at: np.ndarray, most: int, least_df: int = 2) -> np.ndarray:
    """Feature numbers with the largest chi-square against y over the rows ``at``."""
    use = np.zeros(len(rows), bool)
    use[at] = True
    owner = rows.owner
    inside = use[owner]
    f, t = rows.features[inside], y[owner[inside]]
    n = np.bincount(f, minlength=len(rows.hashes)).astype(float)
    pos = np.bincount(f, t, len(rows.hashes))
    total, share = len(at), y[at].mean() if len(at) else 0.0
    expect = n * share
    spread = np.maximum(n * share * (1 - share) * (1 - n / max(total, 1)), 1e-9)
    chi = (pos - expect) ** 2 / spread
    chi[n < least_df] = 0
    best = np.argsort(-chi, kind="stable")[:most]
    return best[chi[best] > 3.84]  # 5 % level of one degree of freedom


def fit(rows: Rows, dense: np.ndarray, y: np.ndarray, at: np.ndarray, most_features: int = 4096,
        l2: float = 1.0, steps: int = 120, weight: np.ndarray | None = None) -> Linear:
    """Fit on the rows ``at``.  Deterministic: full-batch Adam from zero."""
    y = y.astype(float)
    keep = informative(rows, y, at, most_features)
    number = np.full(len(rows.hashes), -1, np.int64)
    number[keep] = np.arange(len(keep))
    place = np.full(len(rows), -1, np.int64)
    place[at] = np.arange(len(at))
    owner = place[rows.owner]
    f = number[rows.features]
    inside = (owner >= 0) & (f >= 0)
    owner, f = owner[inside], f[inside]
    d, t = dense[at], y[at]
    c = np.ones(len(at)) if weight is None else weight[at]
    c = c / max(c.sum(), 1e-12)
    n, k = len(keep), d.shape[1]
    p = np.zeros(n + k + 1)
    share = min(max(float((c * t).sum()), 1e-3), 1 - 1e-3)
    p[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        z = p[-1] + np.bincount(owner, p[f], len(at)) + (d @ p[n:-1] if k else 0.0)
        g = c * (sigmoid(z) - t)
        grad = np.concatenate([np.bincount(f, g[owner], n), d.T @ g if k else np.zeros(0), [g.sum()]])
        grad[:-1] += l2 * p[:-1] / max(len(at), 1)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad ** 2
        p -= 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
    order = np.argsort(rows.hashes[keep])
    return Linear(float(p[-1]), rows.hashes[keep][order], p[:n][order], p[n:-1].copy())


def best_threshold(p: np.ndarray, y: np.ndarray, cost_false_alarm: float = 1.0) -> float:
    """The cut on p with the fewest errors (false alarms weighted), halfway to
    the next lower score; 0.5 if y has one class only."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    missed = (y == 1).sum() - np.cumsum(y == 1)
    false = np.cumsum(y == 0)
    cost = missed + cost_false_alarm * false
    last = np.append(p[1:] != p[:-1], True)  # a cut can't part equal scores
    cost = np.where(last, cost, np.inf)
    i = int(np.argmin(cost))
    below = p[i + 1] if i + 1 < len(p) else 0.0
    return float((p[i] + below) / 2)
