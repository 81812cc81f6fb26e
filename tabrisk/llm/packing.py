"""Packing token sequences by cutting-stock column generation.

1. Every document is tokenized and cut into whole sequences and a rest; a
   piece's CRC is taken on the spot, so ids are never shuffled.
2. The histogram of piece lengths (at most 4,096 whatever the input) goes to
   the driver.  There, in steps of ``STEP`` tokens (256 bins), a linear program
   over patterns (how many pieces of each length share a sequence) is solved by
   column generation: the duals of the restricted program price the lengths, a
   knapsack dynamic program finds the pattern of most value, and it enters the
   basis until none is worth more than its sequence.
3. Patterns are used floor(x) times each.  What rounding leaves, and the pieces
   of patterns that would leave much room by their true lengths (so all short
   pieces), are laid end to end in strips by exact length, and cut where a
   sequence is full (at a multiple of ``CUT`` tokens).
4. Pieces are ranked inside their length (count per hash bucket, running
   totals, rank inside the bucket), and rank r of a length takes the r-th slot
   that the patterns, then the strips, have for it.  Offsets are running sums
   in a sequence.  A cut piece's CRC is put together from its blocks' CRCs.
"""

from __future__ import annotations

import bisect
import os
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.llm import pairing, textscan
from tabrisk.llm.spark_util import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEQUENCE = 4096
STEP = 16
#: Tokens of a block; a rest may be cut between blocks.
CUT = 64
#: Pieces of a strip that the driver lays out (a strip is used many times).
STRIP = 8192
END_ID = 2
#: Words whose ids a Python worker remembers at most.
CACHE_WORDS = 1 << 20
#: 1: ASCII letters and digits, 2: ASCII symbols but the apostrophe, 4: other bytes.
KIND = np.full(256, 4, np.uint8)
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
KIND[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = 2


class WordIds:
    """Token ids of words, remembered by hash.  The tokenizer drops white space
    and never joins across it, nor an ASCII letter or digit with a symbol that
    is not an apostrophe, so a text's ids are its words' ids in order."""

    #: A token that the tokenizer finds before anything else, put between words.
    MARK = "<|startoftext|>"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.mark = self.tokenizer.token_to_id(self.MARK)
        self.clear()

    def clear(self):
        self.keys = np.zeros(0, np.uint64)
        self.first = np.zeros(0, np.int32)
        self.count = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint16)

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode_words(self, words: list[str]):
        """(ids of all words, number of ids of each)."""
        if any("<|" in w for w in words):  # special tokens' strings, as the tokenizer reads them
            found = [np.array(self.encode(w), np.uint16) for w in words]
            return np.concatenate(found), np.array([len(x) for x in found], np.int64)
        flat, count = [], []
        for k in range(0, len(words), 512):
            ids = np.array(self.encode(self.MARK.join([*words[k: k + 512], ""])), np.uint16)
            ends = np.flatnonzero(ids == self.mark)
            flat.append(ids[ids != self.mark])
            count.append(np.diff(ends, prepend=-1) - 1)
        return np.concatenate(flat), np.concatenate(count)

    def learn(self, keys: np.ndarray, words: list[str]):
        if len(self.keys) + len(keys) > CACHE_WORDS:
            self.clear()
        flat, count = self.encode_words(words)
        first = len(self.flat) + np.cumsum(count) - count
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        self.first = np.insert(self.first, at, first[order])
        self.count = np.insert(self.count, at, count[order])
        self.flat = np.concatenate([self.flat, flat])
        self.keys = np.insert(self.keys, at, keys[order])

    def where(self, keys):
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        return at, (self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool))

    def of(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, offsets of the ids by document), END_ID after each document."""
        import pandas as pd
        n = len(offsets) - 1
        raw = data.tobytes()
        cut = None
        if b"<|" not in raw and len(data):
            kind = KIND[data]
            cut = np.zeros(len(data), bool)
            np.equal(kind[1:] + kind[:-1], 3, out=cut[1:])  # a letter or digit beside a symbol
        starts, ends, h, doc = textscan.words(data, offsets, cut=cut)
        code, keys = pd.factorize(h)
        at, known = self.where(keys)
        if not known.all():
            seen = np.empty(len(keys), np.int64)
            seen[code[::-1]] = np.arange(len(code))[::-1]
            new = np.flatnonzero(~known)
            before = len(self.keys)
            if before + len(new) > CACHE_WORDS:
                new = np.arange(len(keys))  # the memory starts anew
            self.learn(keys[new], [raw[s:e].decode() for s, e in zip(starts[seen[new]], ends[seen[new]])])
            at, _ = self.where(keys)
        count = self.count[at][code].astype(np.int64)
        place, word = pairing.ranges(self.first[at][code].astype(np.int64), count)
        size = np.bincount(doc, count, n).astype(np.int64) + 1
        out_offsets = np.concatenate([[0], np.cumsum(size)])
        out = np.full(out_offsets[-1], END_ID, np.uint32)
        out[np.arange(len(place)) + doc[word]] = self.flat[place]
        return out, out_offsets


def word_ids(path: str) -> WordIds:
    """The worker's WordIds for a vocabulary; later tasks of the worker use it too."""
    shelf = sys.modules.setdefault("_tabrisk_word_ids", types.ModuleType("_tabrisk_word_ids"))
    if path not in shelf.__dict__:
        shelf.__dict__[path] = WordIds(path)
    return shelf.__dict__[path]


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           sequence: int = SEQUENCE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, blocks) of each piece: whole
    sequences from the document's start, then the rest, with the CRCs of its
    blocks of ``CUT`` tokens (4 bytes each).  No shuffle."""
    def run(batches):
        made = word_ids(vocabulary)
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column(1)):
                ids, at = made.of(data, offsets)
                size = np.diff(at)
                number = -(-size // sequence)
                start, doc = pairing.ranges(np.zeros(last - first, np.int64), number)
                start = start * sequence
                length = np.minimum(sequence, size[doc] - start)
                raw = memoryview(ids.astype("<u4")).cast("B")
                begin = (at[doc] + start) * 4
                crc, blocks = [], []
                for a, b in zip(begin.tolist(), (begin + length * 4).tolist()):
                    crc.append(zlib.crc32(raw[a:b]))
                    blocks.append(b"" if b - a == 4 * sequence else np.array(
                        [zlib.crc32(raw[c: min(c + 4 * CUT, b)]) for c in range(a, b, 4 * CUT)], "<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, last - first).take(pa.array(doc)), pa.array(start), pa.array(length),
                     pa.array(crc, pa.int64()), pa.array(size[doc]), pa.array(blocks, pa.binary())],
                    names=["id", "start", "length", "ids_crc32", "doc_tokens", "blocks"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, blocks binary")


def zeros_operator(size: int) -> list[int]:
    """What ``size`` zero bytes do to a CRC-32 register, bit by bit (a linear
    map), by repeated squaring."""
    def apply(m, v):
        out, i = 0, 0
        while v:
            if v & 1:
                out ^= m[i]
            v, i = v >> 1, i + 1
        return out

    one_bit = [0xEDB88320] + [1 << i for i in range(31)]
    power = one_bit
    for _ in range(3):
        power = [apply(power, x) for x in power]  # one byte
    total = [1 << i for i in range(32)]
    while size:
        if size & 1:
            total = [apply(power, x) for x in total]
        power = [apply(power, x) for x in power]
        size >>= 1
    return total


def joined_crc(parts: np.ndarray, last: int, operators: dict[int, list[int]]) -> int:
    """CRC-32 of blocks in a row from theirs; all have ``CUT`` tokens but the
    last, which has ``last``."""
    total = 0
    for i, crc in enumerate(parts.tolist()):
        size = 4 * (last if i == len(parts) - 1 else CUT)
        if size not in operators:
            operators[size] = zeros_operator(size)
        shifted = 0
        for bit, image in enumerate(operators[size]):
            if total >> bit & 1:
                shifted ^= image
        total = shifted ^ crc
    return total


def best_pattern(value: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the counts of sizes 1..len(value) that fit in
    ``room`` with the largest total value."""
    best, last = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    for c in range(1, room + 1):
        sizes = min(c, len(value))
        total = best[c - sizes: c][::-1] + value[:sizes]
        i = int(np.argmax(total))
        if total[i] > best[c - 1] + 1e-12:
            best[c], last[c] = total[i], i + 1
        else:
            best[c] = best[c - 1]  # one unit stays empty
    counts = np.zeros(len(value), np.int64)
    c = room
    while c > 0:
        if last[c]:
            counts[last[c] - 1] += 1
            c -= last[c]
        else:
            c -= 1
    return float(best[room]), counts


def solve(demand: np.ndarray, room: int, spare: float, mean: np.ndarray, slack: float = 5e-4, rounds: int = 4000):
    """Patterns and how often each is used, for ``demand[i]`` pieces of i + 1
    units in sequences of ``room`` units, and the pieces left over.  The linear
    program ends within ``slack`` of its best value (by the pieces' total size,
    or by the best pattern's price); patterns that leave over ``spare`` units
    empty, at the bins' mean true sizes ``mean``, are not used."""
    sizes = np.flatnonzero(demand)
    if not len(sizes):
        return [], np.zeros(len(demand), np.int64)
    d = demand[sizes].astype(float)
    n = len(sizes)
    columns = np.diag((room // (sizes + 1)).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ d
    least = float(d @ (sizes + 1)) / room
    for _ in range(rounds):
        if x.sum() <= least * (1 + slack):
            break
        dual = inverse.sum(axis=0)  # every sequence costs one
        value = np.zeros(len(demand))
        value[sizes] = dual
        worth, counts = best_pattern(value, room)
        least = max(least, x.sum() / worth)
        if worth <= 1 + 1e-6:
            break
        a = counts[sizes].astype(float)
        step = inverse @ a
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, x / step, np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        t = ratio[r]
        x = np.maximum(x - t * step, 0)
        x[r] = t
        row = inverse[r] / step[r]
        inverse -= np.outer(step, row)
        inverse[r] = row
        columns[:, r] = a
    left = demand.astype(np.int64).copy()
    used = []
    for j in np.argsort(-x, kind="stable"):
        a = np.rint(columns[:, j]).astype(np.int64)
        own = np.flatnonzero(a)
        if room - (a * mean[sizes]).sum() > spare:
            continue
        times = int(min(np.floor(x[j] + 1e-7), (left[sizes[own]] // a[own]).min()))
        if times > 0:
            left[sizes] -= a * times
            full = np.zeros(len(demand), np.int64)
            full[sizes] = a
            used.append((full, times))
    return used, left


def lay_strip(counts: np.ndarray, room: int, unit: int, whole: bool = True) -> tuple[list[tuple[int, int, int, int, int]], int, np.ndarray]:
    """Lay ``counts[i]`` pieces of i + 1 units into sequences of ``room`` units,
    cutting a piece at a multiple of ``unit`` units where the next does not
    fit.  Returns (length bin, number of the piece in its bin, first unit, end
    unit or -1 for the piece's end, sequence), the number of sequences, and the
    pieces not laid: none if ``whole``, else what would fill no sequence."""
    left, out = counts.astype(np.int64), []
    units = int(left @ np.arange(1, len(left) + 1))
    sizes = [int(i) + 1 for i in np.flatnonzero(left)]
    rest = None  # the piece that the last sequence cut: bin, number, first unit
    sequence = 0

    def take(at):
        nonlocal units
        i = sizes[at] - 1
        left[i] -= 1
        units -= i + 1
        if not left[i]:
            del sizes[at]
        return i

    while rest or units and (whole or units >= room):
        free = room
        if rest:
            i, k, begin = rest
            out.append((i, k, begin, -1, sequence))
            free -= i + 1 - begin
            rest = None
        at = bisect.bisect_right(sizes, free) - 1
        while at >= 0:
            size = sizes[at]
            for _ in range(min(int(left[size - 1]), free // size)):
                i = take(at)
                free -= size
                out.append((i, int(left[i]), 0, -1, sequence))
            at = min(bisect.bisect_left(sizes, size), bisect.bisect_right(sizes, free)) - 1
        cut = free // unit * unit
        larger = bisect.bisect_right(sizes, cut)
        if cut and larger < len(sizes):
            i = take(larger)
            out.append((i, int(left[i]), 0, cut, sequence))
            rest = (i, int(left[i]), cut)
        sequence += 1
    return out, sequence, left


def strips(left: np.ndarray, room: int, unit: int, size: int = STRIP):
    """Strips that use up ``left``: (pieces of each bin in a strip, its layout,
    its sequences, how often it is used).  The first are used many times, so
    that the layout is bounded whatever the number of pieces; what would fill
    no sequence of theirs is left to the next."""
    left, out = left.copy(), []
    size = max(size, 2 * room)
    while left.any():
        times = max(1, int(left.sum()) // size)
        layout, sequences, over = lay_strip(left // times, room, unit, whole=times == 1)
        counts = left // times - over
        # pieces are numbered from the last one down: the laid ones from 0
        out.append((counts, [(i, k - int(over[i]), b, e, s) for i, k, b, e, s in layout], sequences, times))
        left -= counts * times
    return out


class Plan:
    """Where the r-th piece of each length goes: ``demand[i]`` pieces of i + 1
    units, in sequences of ``room`` units.  Patterns are made for lengths in
    steps of ``step`` units."""

    def __init__(self, demand: np.ndarray, room: int, unit: int, step: int = 1):
        bins = len(demand)
        length = np.arange(1, bins + 1)
        coarse = (length - 1) // step
        steps = room // step
        total = np.bincount(coarse, demand, steps).astype(np.int64)
        mean = np.bincount(coarse, demand * length, steps) / np.maximum(total, 1) / step
        used, _ = solve(total[:steps], steps, unit / step, mean[:steps])
        left = demand.astype(np.int64)
        # slots, first sequence, slots per sequence, strip or -1, slots before them
        runs: list[list[tuple]] = [[] for _ in range(bins)]
        sequence = 0
        for counts, times in used:
            for c in np.flatnonzero(counts):
                slots, before = int(counts[c]) * times, 0
                for i in range(min(bins, (int(c) + 1) * step) - 1, int(c) * step - 1, -1):  # the longest lose least
                    n = min(int(left[i]), slots - before)
                    if n:
                        runs[i].append((n, sequence, int(counts[c]), -1, before))
                        left[i] -= n
                        before += n
            sequence += times
        self.fragments, self.step = {}, []
        for s, (counts, layout, sequences, times) in enumerate(strips(left, room, unit)):
            for i in np.flatnonzero(counts):
                runs[i].append((int(counts[i]) * times, sequence, int(counts[i]), s, 0))
            for i, k, begin, end, at in layout:
                self.fragments.setdefault((s, i, k), []).append((begin, end, at))
            self.step.append(sequences)
            sequence += sequences * times
        self.base = np.cumsum([0] + [sum(x[0] for x in r) for r in runs])[:-1]
        flat = [x for r in runs for x in r] or [(0, 0, 1, -1, 0)]
        size = np.array([x[0] for x in flat], np.int64)
        self.first = np.cumsum(size) - size
        self.begin, self.per, self.strip, self.before = (np.array([x[j] for x in flat], np.int64) for j in (1, 2, 3, 4))

    def place(self, bins: np.ndarray, rank: np.ndarray):
        """(row, first unit, end unit or -1, sequence) of each fragment."""
        at = self.base[bins] + rank
        run = np.searchsorted(self.first, at, "right") - 1
        number = at - self.first[run] + self.before[run]
        strip = self.strip[run]
        whole = np.flatnonzero(strip < 0)
        row, begin, end = whole.tolist(), [0] * len(whole), [-1] * len(whole)
        sequence = (self.begin[run] + number // self.per[run])[whole].tolist()
        for r in np.flatnonzero(strip >= 0).tolist():
            s, turn, k = int(strip[r]), *divmod(int(number[r]), int(self.per[run[r]]))
            for b, e, own in self.fragments[(s, int(bins[r]), k)]:
                row.append(r)
                begin.append(b)
                end.append(e)
                sequence.append(int(self.begin[run[r]]) + turn * self.step[s] + own)
        return np.array(row, np.int64), np.array(begin, np.int64), np.array(end, np.int64), np.array(sequence, np.int64)


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
         sequence: int = SEQUENCE, step: int = STEP) -> DataFrame:
    """One row for each piece of every document, with its place:
    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text is one piece with the end id alone.  Repeated rows
    and ids are packed like any other rows; extra columns are ignored; an empty
    table gives no row.  A text of any length is cut, never dropped.
    """
    made = written(pieces(docs, vocabulary, id_col, text_col, sequence), "pieces")
    made = made.withColumn("bin", (F.col("length") - 1).cast("int"))
    demand = np.zeros(sequence, np.int64)
    for row in made.groupBy("bin").count().collect():  # at most ``sequence`` rows
        demand[row["bin"]] = row["count"]
    plan = Plan(demand, sequence, CUT, step)
    n = int(demand.sum())
    buckets = -(-n // max(1024, int(n ** 0.5))) if n else 1
    bucketed = made.withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(bucketed.groupBy("bin", "bucket").count()
                              .withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0)))
                              .select("bin", "bucket", "before"), "bucket-offsets")
    inside = Window.partitionBy("bin", "bucket").orderBy("length", "id", "start", "ids_crc32", "doc_tokens")
    ranked = (bucketed.join(offsets, ["bin", "bucket"])
                      .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1))
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches):
        operators: dict[int, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            row, begin, end, sequence_id = plan.place(batch.column(6).to_numpy(), batch.column(7).to_numpy())
            start, length, crc = (batch.column(i).to_numpy() for i in (1, 2, 3))
            end = np.where(end < 0, length[row], end)
            new = crc[row].copy()
            for f in np.flatnonzero(end - begin < length[row]).tolist():
                parts = np.frombuffer(batch.column(5)[row[f]].as_py(), "<u4")[begin[f] // CUT: -(-end[f] // CUT)]
                new[f] = joined_crc(parts, int(end[f] - begin[f]) - CUT * (len(parts) - 1), operators)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), pa.array(start[row] + begin), pa.array(end - begin), pa.array(new),
                 batch.column(4).take(take), pa.array(sequence_id)], names=[*columns, "sequence_id"])

    kind = docs.schema[id_col].dataType.simpleString()
    placed = ranked.select(*columns, "blocks", "bin", "rank").mapInArrow(
        place, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long")
    within = (Window.partitionBy("sequence_id").orderBy(F.desc("length"), "id", "start", "ids_crc32", "doc_tokens")
                    .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
                  .withColumnRenamed("id", id_col))
