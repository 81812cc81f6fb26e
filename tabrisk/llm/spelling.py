"""Spelling variant grouping by finite-state composition.

The vocabulary is seen as an acceptor; it is composed with a transducer that
makes exactly one edit (a code point inserted, deleted or replaced) and with
the acceptor again, and the accepted pairs are the near words.  The composed
machine is enumerated in partitions by initial state:

* Two near words whose shorter has m code points and whose common beginning
  has p agree, for any region a <= p < b of positions, on the first a and the
  last m - b code points.  So the m positions are cut into regions, and words
  with equal (m, region, beginning, ending) form one partition: the words that
  the acceptor reads on from the state after the beginning, up to the states
  before the ending.  Each pair is accepted in one partition only, the one of
  its p.
* A partition with over ``limit`` words has its region halved until it is
  smaller or has one position, in which case the alphabet bounds it.
* A task takes whole partitions, builds their common minimised acceptor level
  by level in NumPy and walks the product states (p, edits, q), all paths of
  a level at once; words are numbered by the counts of accepted words, so no
  string is made on the way.

A task returns, for each word, its number of near words and its best one;
pairs are never rows.  Forms are followed to their roots by pointer doubling.
"""

from __future__ import annotations

import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import pairing, textscan
from tabrisk.llm.spark_util import written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST_LENGTH, LEAST_COUNT, ONE_IN = 5, 3, 97
#: Positions of a region at first, and words of a partition that is not halved.
REGION, LIMIT = 32, 50_000
#: Rows of whole partitions that one machine is built for.
CHUNK = 30_000
#: Longer words get their CRC one by one.
CRC_BYTES = 64

LETTER = textscan.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])


def crc_table() -> np.ndarray:
    """The byte table of CRC-32 (reflected polynomial EDB88320)."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def crcs(data: np.ndarray, starts: np.ndarray, size: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of the spans of ``data``, carried on from the CRCs ``before``."""
    table = crc_table()
    order = np.argsort(-size, kind="stable")
    at, left = starts[order], size[order]
    reg = before[order] ^ np.uint32(0xFFFFFFFF)
    long = int(np.searchsorted(-left, -CRC_BYTES, "left"))  # more than CRC_BYTES: one by one
    for j in range(CRC_BYTES):
        n = int(np.searchsorted(-left, -j, "left"))
        if n <= long:
            break
        r = reg[long:n]
        reg[long:n] = table[(r ^ data[at[long:n] + j]) & np.uint32(0xFF)] ^ (r >> np.uint32(8))
    out = np.empty(len(starts), np.uint32)
    out[order] = reg ^ np.uint32(0xFFFFFFFF)
    for i in order[:long]:
        out[i] = zlib.crc32(data[starts[i]: starts[i] + size[i]].tobytes(), int(before[i]))
    return out


def letter_runs(data: np.ndarray, offsets: np.ndarray):
    """Starts, ends and texts of the maximal runs of A-Z, a-z and U+00C0 to
    U+00FF (in UTF-8: C3 and the byte after it)."""
    lead = data == 0xC3
    inside = LETTER[data] | lead
    inside[1:] |= lead[:-1]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets] = True
    starts = np.flatnonzero(inside & (fresh[:-1] | np.append(True, ~inside[:-1])[: len(data)]))
    ends = np.flatnonzero(inside & (fresh[1:] | np.append(~inside[1:], True))) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def slice_words(data: np.ndarray, offsets: np.ndarray, ids: list) -> tuple[pa.Array, pa.Array]:
    """Distinct words of some texts and their numbers of occurrences."""
    starts, ends, doc = letter_runs(data, offsets)
    points = textscan.code_points(data)
    length = points[ends] - points[starts]
    keep = length >= LEAST_LENGTH
    starts, ends, doc, length = starts[keep], ends[keep], doc[keep], length[keep]
    size = ends - starts
    # the words end to end, A-Z lower-cased
    take, _ = pairing.ranges(starts, size)
    flat = textscan.LOWER[data[take]]
    edges = np.append(0, np.cumsum(size))
    before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    h = crcs(flat, edges[:-1], size, before[doc])
    words = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(flat))
    hit = h % np.uint32(ONE_IN) == 0
    cut = []
    for word, at in zip(words.filter(pa.array(hit)).to_pylist(), h[hit] % length[hit]):
        word = word[:at] + word[at + 1:]
        if len(word) >= LEAST_LENGTH:
            cut.append(word)
    words = pa.concat_arrays([words.filter(pa.array(~hit)), pa.array(cut, pa.large_string())])
    counts = pc.value_counts(words)
    return counts.field("values").cast(pa.string()), counts.field("counts")


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(wid, word, n) of every word, written; wid follows the words' code-point order."""
    def run(batches):
        for batch in batches:
            for first, last, data, offsets in textscan.slices(batch.column(1)):
                if len(data):
                    words, n = slice_words(data, offsets, batch.column(0).slice(first, last - first).to_pylist())
                    yield pa.RecordBatch.from_arrays([words, n], names=["word", "n"])

    counted = (docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
                   .mapInArrow(run, "word string, n long")
                   .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT))
    # written before the sort, which would run it twice
    ordered = written(counted, "spelling-counts").orderBy("word")
    return written(ordered.select(F.monotonically_increasing_id().alias("wid"), "word", "n"), "spelling-words")


def entries(rows: DataFrame) -> DataFrame:
    """(wid, n, word, m, a, b) -> those, the partition's key and the part of
    the word inside the region (``middle``, one byte for a code point)."""
    m, a, b, word = F.col("m"), F.col("a"), F.col("b"), F.col("word")
    size = F.length(word)
    head, tail = F.substring(word, F.lit(1), a), F.substring(word, size - m + b + 1, m - b)
    key = [F.xxhash64(F.lit(salt), m, a, b, head, tail).alias(f"k{salt}") for salt in (1, 2)]
    middle = F.encode(F.substring(word, a + 1, size - m + b - a), "ISO-8859-1")
    return rows.select(*key, "wid", "n", "m", "a", "b", middle.alias("middle"))


def regions(words: DataFrame, region: int) -> DataFrame:
    """Each word as the shorter (m = its length) and as the longer (m = its
    length - 1) of a pair, in every region of the m positions."""
    size = F.length("word").cast("int")
    out = words.select("*", F.explode(F.when(size > LEAST_LENGTH, F.array(size - 1, size)).otherwise(F.array(size))).alias("m"))
    parts = F.greatest(F.lit(2), F.ceil(F.col("m") / region)).cast("int")
    out = out.select("*", parts.alias("parts")).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    edge = lambda i: F.floor(F.col("m").cast("long") * i / F.col("parts")).cast("int")
    return out.select("wid", "n", "word", "m", edge(F.col("i")).alias("a"), edge(F.col("i") + 1).alias("b"))


def partitions(words: DataFrame, region: int, limit: int) -> DataFrame:
    """All entries; a partition of over ``limit`` rows has its region halved."""
    todo, done = regions(words, region), []
    while True:
        got = entries(todo)
        hot = (got.where(F.col("b") - F.col("a") > 1).groupBy("k1", "k2").count()
                  .where(F.col("count") > limit).select("k1", "k2"))
        hot = written(hot, "spelling-hot")
        if hot.isEmpty():
            done.append(got)
            break
        done.append(got.join(hot, ["k1", "k2"], "left_anti"))
        split = got.join(hot, ["k1", "k2"], "left_semi").select("wid", "m", "a", "b")
        mid = F.col("a") + F.floor((F.col("b") - F.col("a")) / 2).cast("int")
        halves = split.select("wid", "m", F.explode(F.array(
            F.struct(F.col("a").alias("a"), mid.alias("b")), F.struct(mid.alias("a"), F.col("b").alias("b")))).alias("r"))
        todo = written(halves.join(words, "wid").select("wid", "n", "word", "m", "r.a", "r.b"), "spelling-halves")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


class Acceptor:
    """The minimised acceptor of sorted, distinct byte strings in groups: one
    initial state for each group; arcs by state and label; the number of
    strings that each state accepts."""

    def __init__(self, text: np.ndarray, size: np.ndarray, group: np.ndarray):
        n, width = text.shape
        fresh = np.append(True, group[1:] != group[:-1])
        # common beginning with the row before, -1 at a group's first row
        same = np.cumprod(text[1:] == text[:-1], axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64)
        common = np.append(0, np.minimum(same, np.minimum(size[1:], size[:-1])))
        common = np.where(fresh, -1, common)
        depth = np.arange(width + 1)
        new = (depth > common[:, None]) & (depth <= size[:, None])
        node = np.where(new, np.cumsum(new).reshape(new.shape), 0)
        node = np.maximum.accumulate(node, axis=0) - 1
        row, at = np.nonzero(new)
        count = len(row)
        final = np.zeros(count, bool)
        final[node[np.arange(n), size]] = True
        # arcs from the node at depth d - 1 to the new node at depth d, in the order of rows
        inner = at > 0
        child = np.flatnonzero(inner)
        parent = node[row[inner], at[inner] - 1]
        label = text[row[inner], at[inner] - 1].astype(np.int64)
        height = np.zeros(count, np.int64)
        for d in range(width, 0, -1):
            own = at[child] == d
            np.maximum.at(height, parent[own], height[child[own]] + 1)
        order = np.lexsort([label, parent])
        child, parent, label = child[order], parent[order], label[order]
        degree = np.bincount(parent, minlength=count)
        first = np.cumsum(degree) - degree
        # nodes with the same arcs to the same classes are one state
        state = np.zeros(count, np.int64)
        chosen = []
        total = 0
        for h in range(int(height.max()) + 1 if count else 0):
            own = np.flatnonzero(height == h)
            cls = degree[own] * 2 + final[own]
            for j in range(int(degree[own].max())):
                more = np.flatnonzero(degree[own] > j)
                arc = first[own[more]] + j
                code = (cls[more] * 256 + label[arc]) * (total + 1) + state[child[arc]]
                cls[more] = np.unique(code, return_inverse=True)[1]
                # nodes that have more arcs stay apart from those that end here
                cls[more] = cls[more] * (2 * 256) + degree[own[more]] * 2 + final[own[more]]
            _, rep, number = np.unique(cls * 512 + degree[own] * 2 + final[own], return_index=True, return_inverse=True)
            state[own] = total + number
            chosen.append(own[rep])
            total += len(rep)
        nodes = np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
        self.final = final[nodes]
        self.degree = degree[nodes]
        arcs, owner = pairing.ranges(first[nodes], self.degree)
        self.first = np.cumsum(self.degree) - self.degree
        self.label, self.target = label[arcs], state[child[arcs]]
        self.key = owner * 256 + self.label
        # strings accepted from a state: states are numbered by height, so targets come first
        self.strings = self.final.astype(np.int64)
        h = height[nodes]
        for level in range(1, int(h.max()) + 1 if len(h) else 0):
            own = h[owner] == level
            np.add.at(self.strings, owner[own], self.strings[self.target[own]])
        # an arc's offset: strings of its state that come before those through it
        ahead = np.cumsum(self.strings[self.target]) - self.strings[self.target]
        self.offset = ahead - np.repeat(ahead[np.minimum(self.first, max(len(ahead) - 1, 0))] if len(ahead) else ahead, self.degree) \
            + np.repeat(self.final.astype(np.int64), self.degree) if len(ahead) else np.zeros(0, np.int64)
        self.initial = state[node[fresh, 0]]

    def step(self, p: np.ndarray, q: np.ndarray):
        """Pairs of arcs with equal labels out of the state pairs (p, q):
        (row, arc of p, arc of q)."""
        arc, row = pairing.ranges(self.first[p], self.degree[p])
        want = q[row] * 256 + self.label[arc]
        at = np.minimum(np.searchsorted(self.key, want), max(len(self.key) - 1, 0))
        ok = self.key[at] == want if len(self.key) else np.zeros(0, bool)
        return row[ok], arc[ok], at[ok]


def near_pairs(text: np.ndarray, size: np.ndarray, group: np.ndarray, width: np.ndarray, last: np.ndarray):
    """Numbers (i, j) of all rows of one group that differ by one edit.

    Rows are sorted by (group, string).  ``width`` and ``last`` (by group): the
    region's positions, and whether it is the last one.  Two longer words
    (size width + 1) are another partition's pair, as is an insertion after
    the region unless it is the last.
    """
    machine = Acceptor(text, size, group)
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    # paths without an edit: state, number of the first string through it, group
    s, i, g = machine.initial, first.astype(np.int64), np.arange(len(first))
    none = np.zeros(0, np.int64)
    p, q, ip, iq, ban = none, none, none, none, none
    out = []
    depth = 0
    while len(s) or len(p):
        # replaced: two arcs of one state
        arc, row = pairing.ranges(machine.first[s], machine.degree[s])
        rest = (machine.first[s] + machine.degree[s])[row] - arc - 1
        other, own = pairing.ranges(arc + 1, rest)
        left, row2 = arc[own], row[own]
        # inserted: the longer word takes an arc, the shorter stays
        free = (depth < width[g[row]]) | last[g[row]]
        more, mrow = arc[free], row[free]
        p = np.concatenate([p, machine.target[left], s[mrow]])
        q = np.concatenate([q, machine.target[other], machine.target[more]])
        ip, iq = (np.concatenate([ip, i[row2] + machine.offset[left], i[mrow]]),
                  np.concatenate([iq, i[row2] + machine.offset[other], i[mrow] + machine.offset[more]]))
        # the first difference must be where the edit is: the shorter word may not go on with the inserted letter
        ban = np.concatenate([ban, np.full(len(left), -1), machine.label[more]])
        fresh = machine.final[p] & machine.final[q]
        out.append((ip[fresh], iq[fresh]))
        # one step on: equal letters on both sides
        row3, ap, aq = machine.step(p, q)
        ok = machine.label[ap] != ban[row3]
        row3, ap, aq = row3[ok], ap[ok], aq[ok]
        ip, iq = ip[row3] + machine.offset[ap], iq[row3] + machine.offset[aq]
        p, q, ban = machine.target[ap], machine.target[aq], np.full(len(row3), -1)
        s, i, g = machine.target[arc], i[row] + machine.offset[arc], g[row]
        depth += 1
    x, y = (np.concatenate(v) for v in zip(*out)) if out else (none, none)
    longer = size > width[np.searchsorted(first, np.arange(len(size)), "right") - 1]
    keep = ~longer[x]
    return x[keep], y[keep]


def group_bests(table: pa.Table):
    """For each row with a near word in its partition: wid, near words, and
    the best one's n and wid."""
    starts = pairing.group_starts(table, ["k1", "k2"])
    rows = np.diff(np.append(starts, table.num_rows))
    group = np.repeat(np.arange(len(starts)), rows)
    some = np.repeat(rows > 1, rows)
    if not some.any():
        return None
    table, group = table.filter(pa.array(some)), np.unique(group[some], return_inverse=True)[1]
    middle = table.column("middle").combine_chunks().cast(pa.large_binary())
    edges = np.frombuffer(middle.buffers()[1], np.int64)[middle.offset: middle.offset + len(middle) + 1]
    size = np.diff(edges)
    text = np.zeros((len(size), int(size.max()) if len(size) else 0), np.uint8)
    flat, own = pairing.ranges(edges[:-1], size)
    held = middle.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    text[own, flat - edges[:-1][own]] = data[flat]
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    m, a, b = (table.column(c).to_numpy()[first] for c in ("m", "a", "b"))
    x, y = near_pairs(text, size, group, b - a, b == m)
    if not len(x):
        return None
    wid, n = table.column("wid").to_numpy(), table.column("n").to_numpy()
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    order = np.lexsort([wid[y], -n[y], x])
    x, y = x[order], y[order]
    at = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
    return pa.RecordBatch.from_arrays(
        [pa.array(wid[x[at]]), pa.array(np.diff(np.append(at, len(x)))), pa.array(n[y[at]]), pa.array(wid[y[at]])],
        names=["wid", "n_near", "near_n", "near_wid"])


def near_words(words: DataFrame, region: int = REGION, limit: int = LIMIT) -> DataFrame:
    """(wid, n_near, near_n, near_wid) of every word that has near words:
    their number, and the one of largest n (ties: the first in order)."""
    def run(batches):
        for table in pairing.whole_groups(batches, ["k1", "k2"], CHUNK):
            out = group_bests(table)
            if out is not None:
                yield out

    parts = partitions(words, region, limit).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "middle")
    best = parts.mapInArrow(run, "wid long, n_near long, near_n long, near_wid long")
    return (best.groupBy("wid").agg(F.sum("n_near").alias("n_near"),
                                    F.max(F.struct("near_n", (-F.col("near_wid")).alias("minus"))).alias("best"))
                .select("wid", "n_near", F.col("best.near_n").alias("near_n"), (-F.col("best.minus")).alias("near_wid")))


def roots(links: DataFrame) -> DataFrame:
    """(wid, form_wid) -> (wid, root_wid): forms followed to the last word.
    A form has at least twice its word's n, so there is no cycle, and each
    round doubles the steps followed."""
    up = written(links.select("wid", F.col("form_wid").alias("root_wid")), "spelling-roots")
    while True:
        hop = up.select(F.col("wid").alias("root_wid"), F.col("root_wid").alias("further"))
        up = written(up.join(hop, "root_wid", "left").select(
            "wid", F.coalesce("further", "root_wid").alias("root_wid"), F.col("further").isNotNull().alias("moved")), "spelling-roots")
        moved = up.where("moved").isEmpty()
        up = up.select("wid", "root_wid")
        if moved:
            return up


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             region: int = REGION, limit: int = LIMIT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    Words are the lower-cased (A-Z) letter runs of the whole texts, one in 97
    of a document's runs with a code point less, of at least 5 code points and
    3 occurrences.  A null text has no words, a null id counts as the empty
    string; repeated rows count again; ties of n go to the smaller word; extra
    columns are ignored; an empty table gives an empty result.  A word of any
    length is handled (its regions stay short).
    """
    words = vocabulary(docs, id_col, text_col)
    near = written(near_words(words, region, limit), "spelling-near")
    forms = (near.join(words.select("wid", "n"), "wid").where(F.col("near_n") >= 2 * F.col("n"))
                 .select("wid", F.col("near_wid").alias("form_wid"), F.col("near_n").alias("form_n")))
    forms = written(forms, "spelling-forms")
    name = lambda kind: words.select(F.col("wid").alias(f"{kind}_wid"), F.col("word").alias(kind))
    named = (forms.join(roots(forms), "wid").join(name("form"), "form_wid").join(name("root"), "root_wid")
                  .select("wid", "form", "root", "form_n"))
    return (words.join(near.select("wid", "n_near"), "wid", "left").join(named, "wid", "left")
                 .select("word", "form", F.coalesce("root", "word").alias("root"), "n",
                         F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
