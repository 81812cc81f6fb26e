"""Arrow text columns as flat byte arrays, and their words, in NumPy.

Helpers that run inside Spark tasks.  A batch of texts is one byte array plus
document offsets; words are found with a 256-entry byte class, and every word
gets a 64-bit polynomial hash from prefix sums.  No per-word Python objects
are made, and memory stays a small multiple of the batch's bytes.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of text handled at a time inside a task (a longer text is one slice).
SLICE_BYTES = 2 << 20
#: Bytes whose prefix sums are held at a time (a longer word is one block).
BLOCK_BYTES = 1 << 20

_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))


def byte_class(spec) -> np.ndarray:
    """A 256-entry mask from an iterable of byte values."""
    mask = np.zeros(256, bool)
    mask[list(spec)] = True
    return mask


#: Words that end at ASCII white space, and words of digits, letters and all non-ASCII bytes.
NOT_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
PUNCT = NOT_SPACE & ~ALNUM & ~byte_class([*range(0x00, 0x20), 0x7F])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def slices(column, limit: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) of a string column;
    null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset: column.offset + n + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last, data[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def run_start(outside: np.ndarray, at: int, low: int) -> int:
    """Start of the run of bytes not ``outside`` that ends before ``at``, not below ``low``."""
    first, size = at, 64
    while first > low:
        begin = max(low, first - size)
        stop = np.flatnonzero(outside[begin:first])
        if len(stop):
            return begin + int(stop[-1]) + 1
        first, size = begin, size * 2
    return first


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + 4096)
        made = []
        for base in (_MULT, _INV):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            made.append(np.cumprod(table))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (every input bit reaches every output bit)."""
    h = h.copy()
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def runs(data: np.ndarray, offsets: np.ndarray, member: np.ndarray,
         cut: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes in ``member``; a run never
    crosses from one text into the next, nor a byte at which ``cut`` is set."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = member[data]
    fresh = np.ones(len(data), bool)
    np.logical_not(inside[:-1], out=fresh[1:])
    edges = offsets[:-1]
    fresh[edges[edges < len(data)]] = True
    if cut is not None:
        fresh |= cut
    starts = np.flatnonzero(inside & fresh)
    after = np.ones(len(data), bool)
    np.logical_not(inside[1:], out=after[:-1])
    edges = offsets[1:-1]
    after[edges[edges > 0] - 1] = True
    if cut is not None:
        after[:-1] |= cut[1:]
    return starts, np.flatnonzero(inside & after) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                fold: np.ndarray = LOWER) -> np.ndarray:
    """64-bit hashes of byte spans (sorted by start), after mapping each byte by ``fold``."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        base = starts[k]
        stop = max(int(np.searchsorted(ends, base + BLOCK_BYTES, "right")), k + 1)
        size = int(ends[stop - 1] - base)
        up, down = _power_tables(size + 1)
        sums = np.empty(size + 1, np.uint64)
        sums[0] = 0
        part = fold[data[base: base + size]].astype(np.uint64)
        part += np.uint64(1)
        part *= up[:size]
        np.cumsum(part, out=sums[1:])
        s = starts[k:stop] - base
        out[k:stop] = (sums[ends[k:stop] - base] - sums[s]) * down[s]
        k = stop
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE,
          fold: np.ndarray = LOWER, cut: np.ndarray | None = None):
    """(starts, ends, hash, document index) of every word, in text order."""
    starts, ends = runs(data, offsets, member, cut)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, span_hashes(data, starts, ends, fold), doc


def word_hash(text: str) -> int:
    """The hash of one word, as ``words`` gives it with the default folding."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(span_hashes(data, np.array([0]), np.array([len(data)]))[0])


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k consecutive words inside one text, and the
    index of each window's first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = total * _MULT + h[j: j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1:])
    return mix(total[at]), at


def code_points(data: np.ndarray) -> np.ndarray:
    """Prefix counts of UTF-8 characters: entry i is the number of characters
    that begin before byte i."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out
