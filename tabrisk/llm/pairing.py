"""NumPy helpers for the pair operators; they run inside tasks."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def whole_groups(batches, keys: list[str], enough: int):
    """Regroup a sorted stream of record batches into tables that hold whole
    groups of ``keys``, each of about ``enough`` rows or one larger group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        fresh = group_starts(table, keys)
        if len(fresh) > 1:
            cut = int(fresh[-1])
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            rows = table.num_rows - cut
        else:
            held = table.to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new group of ``keys`` begins in a sorted table."""
    new = np.zeros(table.num_rows, bool)
    if table.num_rows:
        new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def ranges(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated ranges first[i] .. first[i]+count[i]-1, and the i of each entry."""
    owner = np.repeat(np.arange(len(count)), count)
    before = np.cumsum(count) - count
    return first[owner] + np.arange(len(owner)) - before[owner], owner


def products(fa, na, fb, nb, budget: int):
    """For each i the pairs of fa[i]..+na[i] with fb[i]..+nb[i], in pieces of
    about ``budget`` pairs: yields (left, right, i)."""
    cost = na * nb
    ends = np.cumsum(cost)
    k = 0
    while k < len(cost):
        base = ends[k - 1] if k else 0
        stop = max(int(np.searchsorted(ends, base + budget, "right")), k + 1)
        left, own = ranges(fa[k:stop], na[k:stop])
        right, rep = ranges(fb[k:stop][own], nb[k:stop][own])
        yield left[rep], right, own[rep] + k
        k = stop


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest edges with the components of the edges (a, b): each node but the
    smallest of its component, and that smallest node."""
    if not len(a):
        return a, b
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a):]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        x, y, rx, ry = x[differ], y[differ], rx[differ], ry[differ]
        np.minimum.at(root, np.maximum(rx, ry), np.minimum(rx, ry))
        while True:
            hop = root[root]
            if (hop == root).all():
                break
            root = hop
    own = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[own], nodes[root[own]]
