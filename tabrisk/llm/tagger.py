"""A character-level bidirectional LSTM with a linear-chain CRF, in NumPy.

Fitting takes a bounded sample of labelled windows on the driver; decoding
runs inside tasks on batches of windows of one width.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Hidden units of a direction, passes over the sample, windows of a step, step size.
HIDDEN, EPOCHS, BATCH, RATE = 16, 14, 64, 0.04
SEED = 20


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def run_lstm(x: np.ndarray, table: np.ndarray, u: np.ndarray):
    """Hidden states [step, row, unit] of one direction over symbols
    x[step, row], and what the way back needs."""
    steps, n = x.shape
    k = u.shape[0]
    h, c = np.zeros((n, k), table.dtype), np.zeros((n, k), table.dtype)
    hs, kept = np.empty((steps, n, k), table.dtype), []
    for t in range(steps):
        z = table[x[t]] + h @ u
        gate, g = sigmoid(z[:, : 3 * k]), np.tanh(z[:, 3 * k:])
        before, c_before = h, c
        c = gate[:, k: 2 * k] * c + gate[:, :k] * g
        tc = np.tanh(c)
        h = gate[:, 2 * k:] * tc
        hs[t] = h
        kept.append((before, c_before, gate, g, tc))
    return hs, kept


def lstm_gradient(x: np.ndarray, table: np.ndarray, u: np.ndarray, kept, dh_out: np.ndarray):
    """Gradients of the table and of u, from those of the hidden states."""
    steps, n = x.shape
    k = u.shape[0]
    dzs, du = np.empty((steps, n, 4 * k)), np.zeros_like(u)
    dh, dc = np.zeros((n, k)), np.zeros((n, k))
    for t in range(steps - 1, -1, -1):
        before, c_before, gate, g, tc = kept[t]
        i, f, o = gate[:, :k], gate[:, k: 2 * k], gate[:, 2 * k:]
        dh = dh + dh_out[t]
        dc = dc + dh * o * (1 - tc ** 2)
        dz = np.concatenate([dc * g * i * (1 - i), dc * c_before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g ** 2)], axis=1)
        dzs[t] = dz
        du += before.T @ dz
        dh = dz @ u.T
        dc = dc * f
    dtable = np.zeros_like(table)
    flat = x.ravel()
    order = np.argsort(flat, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(flat[order].astype(int)) != 0))
    dtable[flat[order[first]]] = np.add.reduceat(dzs.reshape(-1, 4 * k)[order], first)
    return dtable, du


@dataclass
class Tagger:
    """``forward`` and ``backward``: (symbol table, recurrent weights);
    ``out``, ``bias``: emissions; ``move``, ``start``: CRF scores;
    ``allowed``: transitions that may occur."""
    forward: tuple
    backward: tuple
    out: np.ndarray
    bias: np.ndarray
    move: np.ndarray
    start: np.ndarray
    allowed: np.ndarray

    def emissions(self, x: np.ndarray) -> np.ndarray:
        ahead, _ = run_lstm(x, *self.forward)
        back, _ = run_lstm(x[::-1], *self.backward)
        return np.concatenate([ahead, back[::-1]], axis=2) @ self.out + self.bias

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best label path [row, step] of symbol rows x[row, step]."""
        e = self.emissions(x.T)
        steps, n, labels = e.shape
        move = np.where(self.allowed, self.move, -1e9).astype(e.dtype)
        best = self.start + e[0]
        from_ = np.empty((steps, n, labels), np.int8)
        for t in range(1, steps):
            paths = best[:, :, None] + move[None]
            from_[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + e[t]
        out = np.empty((steps, n), np.int8)
        out[-1] = best.argmax(axis=1)
        for t in range(steps - 1, 0, -1):
            out[t - 1] = from_[t, np.arange(n), out[t]]
        return out.T


def crf_gradient(e: np.ndarray, y: np.ndarray, move: np.ndarray, start: np.ndarray, allowed: np.ndarray):
    """Mean negative log-likelihood of paths y[step, row] and its gradients
    of emissions, transitions and starts (forward-backward, scaled)."""
    steps, n, labels = e.shape
    a = np.where(allowed, np.exp(move), 0.0)
    top = e.max(axis=2, keepdims=True)
    p = np.exp(e - top)
    alpha, scale = np.empty_like(p), np.empty((steps, n, 1))
    for t in range(steps):
        v = (np.exp(start) if t == 0 else alpha[t - 1] @ a) * p[t]
        scale[t] = v.sum(axis=1, keepdims=True)
        alpha[t] = v / scale[t]
    beta = np.ones_like(p)
    dmove = np.zeros_like(move)
    for t in range(steps - 1, 0, -1):
        w = p[t] * beta[t] / scale[t]
        dmove += a * (alpha[t - 1].T @ w)
        beta[t - 1] = w @ a.T
    own = alpha * beta
    de = own.copy()
    rows = np.arange(n)
    loss = np.log(scale).sum() + top.sum()
    for t in range(steps):
        de[t, rows, y[t]] -= 1
        loss -= e[t, rows, y[t]].sum()
    np.add.at(dmove, (y[:-1].ravel(), y[1:].ravel()), -1.0)
    loss -= move[y[:-1], y[1:]].sum() + start[y[0]].sum()
    dstart = own[0].sum(axis=0) - np.bincount(y[0], minlength=labels)
    return loss / n, de / n, dmove / n, dstart / n


def gradients(p: list, x: np.ndarray, y: np.ndarray, allowed: np.ndarray):
    """Loss and gradients of all parameters on symbol and label rows."""
    x, y = x.T, y.T
    ahead, kept = run_lstm(x, p[0], p[1])
    back, kept_back = run_lstm(x[::-1], p[2], p[3])
    h = np.concatenate([ahead, back[::-1]], axis=2)
    loss, de, dmove, dstart = crf_gradient(h @ p[4] + p[5], y, p[6], p[7], allowed)
    k = p[1].shape[0]
    dh = de @ p[4].T
    out = lstm_gradient(x, p[0], p[1], kept, dh[:, :, :k])
    out_back = lstm_gradient(x[::-1], p[2], p[3], kept_back, dh[::-1, :, k:])
    return loss, [*out, *out_back, np.einsum("tnk,tnl->kl", h, de), de.sum(axis=(0, 1)), dmove, dstart]


def train(x: np.ndarray, y: np.ndarray, symbols: int, allowed: np.ndarray, hidden: int = HIDDEN,
          epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """Fit on symbol rows x[row, step] and label rows y; Adam, deterministic."""
    rng = np.random.default_rng(seed)
    labels = len(allowed)
    p = []
    for _ in range(2):
        table = rng.normal(0, 0.3, (symbols, 4 * hidden))
        table[:, hidden: 2 * hidden] += 1.0  # cells remember at first
        p += [table, rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))]
    p += [rng.normal(0, 0.3, (2 * hidden, labels)), np.zeros(labels), np.zeros((labels, labels)), np.zeros(labels)]
    m, v = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p]
    step, total = 0, epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for first in range(0, len(x), BATCH):
            at = order[first: first + BATCH]
            _, grad = gradients(p, x[at], y[at], allowed)
            size = np.sqrt(sum((g ** 2).sum() for g in grad))
            rate = RATE * min(1.0, 5.0 / max(size, 1e-9)) * (1 - step / total)
            step += 1
            for j, g in enumerate(grad):
                m[j] = 0.9 * m[j] + 0.1 * g
                v[j] = 0.99 * v[j] + 0.01 * g ** 2
                p[j] = p[j] - rate * (m[j] / (1 - 0.9 ** step)) / (np.sqrt(v[j] / (1 - 0.99 ** step)) + 1e-8)
    p = [w.astype(np.float32) for w in p]
    return Tagger((p[0], p[1]), (p[2], p[3]), p[4], p[5], p[6], p[7], allowed)
