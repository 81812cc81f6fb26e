"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Fingerprints: every text's 4-word shingles (repeats count) are hashed with
   XXH64; a bit is set if it is set in over half of the hashes.
2. Equal fingerprints are one node.  A node is dealt to masked bit patterns:
   64 bits in 6 blocks, and with at most 4 differing bits at least two blocks
   are equal, so two nodes that link share one of the 15 two-block patterns.
   These patterns are the index's top level and the shuffle key.
3. Inside a pattern the fingerprints are sorted by Gray rank, and neighbours
   are factored into nodes that keep the bits all their members share.  Node
   pairs are compared from the top down: the differences in the shared bits
   add up along the path, and a pair of groups whose sum is over the limit is
   pruned with all its members.
4. Found links are reduced to spanning stars in the task; connected components
   over the stars give each fingerprint its component.

The search is exact: no link of at most ``max_bits`` bits is lost.  A pattern
that holds many fingerprints is split into pair cells (``pair_cells``), so no
task holds an unbounded group.
"""

from __future__ import annotations

import itertools
import sys

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import pairing, textscan
from tabrisk.llm.spark_util import components, free_names, pair_cells, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Rows of a pattern from which it is split into pair cells.
CELL_ROWS = 4096
#: Fingerprints of an index leaf, leaves of an upper node.
LEAF, FAN = 32, 16


def fingerprint(text: bytes, k: int = SHINGLE_WORDS) -> int:
    """SimHash of one text (UTF-8); 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    flat = b" ".join(words)
    n = max(1, len(words) - k + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(k, len(words)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a block of shingles at a time
        hashes = np.array([digest(flat[s:e], 42) for s, e in
                           zip(starts[at: at + (1 << 16)], ends[at: at + (1 << 16)])], np.uint64)
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n).view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 k: int = SHINGLE_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp long, the columns ``carry``) of every document; no shuffle."""
    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            fps = np.array([fingerprint(t.as_py() or b"", k) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), *batch.columns[2:]],
                                             names=["id", "fp", *carry])

    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *carry).mapInArrow(
        run, f"id {docs.schema[id_col].dataType.simpleString()}, fp long{kinds}")


def block_masks(max_bits: int) -> list[int]:
    """Masks of the top level: 64 bits in max_bits + 2 blocks, any two of them
    (with max_bits differing bits at least two blocks are equal)."""
    n = max_bits + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    return [x | y for x, y in itertools.combinations(blocks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def gray_rank(fp):
    """Position of a fingerprint in Gray order (as an unsigned number)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


class Level:
    """Nodes over consecutive ranges of the level below: first child, children,
    the bits that all members share and their values."""

    def __init__(self, below_mask, below_bits, owner, fan):
        # a node never crosses from one group (owner) into the next
        n = len(owner)
        new = np.ones(n, bool)
        new[1:] = owner[1:] != owner[:-1]
        start = np.flatnonzero(new)
        place = np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))
        self.first = np.flatnonzero(place % fan == 0)
        self.count = np.diff(np.append(self.first, n))
        self.owner = owner[self.first]
        same = np.bitwise_and.reduceat(below_mask, self.first)
        ones = np.bitwise_and.reduceat(below_bits, self.first)
        some = np.bitwise_or.reduceat(below_bits & below_mask, self.first)
        self.mask = same & ~(ones ^ some)
        self.bits = ones & self.mask


def linked_pairs(fp: np.ndarray, owner: np.ndarray, max_bits: int, budget: int = 1 << 20):
    """Row pairs (i < j) of equal owner at most ``max_bits`` bits apart, from
    fingerprints sorted by (owner, Gray rank); yields arrays of i and j."""
    if not len(fp):
        return
    leaf = Level(np.full(len(fp), ~np.uint64(0)), fp, owner, LEAF)
    top = Level(leaf.mask, leaf.bits, leaf.owner, FAN)
    size = np.diff(np.append(np.flatnonzero(np.append(True, top.owner[1:] != top.owner[:-1])), len(top.owner)))
    start = np.cumsum(size) - size
    ahead, _ = pairing.ranges(np.arange(len(top.owner)), np.repeat(start + size, size) - np.arange(len(top.owner)))
    here = np.repeat(np.arange(len(top.owner)), np.repeat(start + size, size) - np.arange(len(top.owner)))
    common = top.mask[here] & top.mask[ahead]
    apart = np.bitwise_count((top.bits[here] ^ top.bits[ahead]) & common)
    keep = apart <= max_bits
    here, ahead, common, apart = here[keep], ahead[keep], common[keep], apart[keep]
    for a, b, of in pairing.products(top.first[here], top.count[here], top.first[ahead], top.count[ahead], budget):
        ok = a <= b
        a, b, of = a[ok], b[ok], of[ok]
        seen = common[of]
        both = leaf.mask[a] & leaf.mask[b]
        # bits that the upper nodes didn't share yet
        far = apart[of] + np.bitwise_count((leaf.bits[a] ^ leaf.bits[b]) & both & ~seen)
        ok = far <= max_bits
        a, b, both, far = a[ok], b[ok], both[ok], far[ok]
        for i, j, pair in pairing.products(leaf.first[a], leaf.count[a], leaf.first[b], leaf.count[b], budget):
            ok = i < j
            i, j, pair = i[ok], j[ok], pair[ok]
            ok = far[pair] + np.bitwise_count((fp[i] ^ fp[j]) & ~both[pair]) <= max_bits
            yield i[ok], j[ok]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Edges (a, b) with the components of all fingerprint pairs at most
    ``max_bits`` bits apart; ``nodes`` holds distinct fingerprints (fp long)."""
    masks = block_masks(max_bits)
    keyed = nodes.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).cast("byte").alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("k"))
        for i, m in enumerate(masks)])).alias("x")).select("fp", "x.m", "x.k")
    keys = ["m", "k", "cell_a", "cell_b"]
    cells = pair_cells(keyed, ["m", "k"], "fp", cell_rows)
    cells = (cells.repartition(*keys).withColumn("rank", gray_rank(F.col("fp")))
                  .sortWithinPartitions(*keys, F.col("rank") < 0, "rank").select(*keys, "side", "fp"))

    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for table in pairing.whole_groups(batches, keys, 1 << 16):
            starts = pairing.group_starts(table, keys)
            size = np.diff(np.append(starts, table.num_rows))
            owner = np.repeat(np.arange(len(size)), size)
            own = np.flatnonzero(size[owner] > 1)  # a fingerprint alone in its pattern links with none
            fp = table.column("fp").to_numpy().view(np.uint64)[own]
            side = table.column("side").to_numpy()[own]
            split = (table.column("cell_a").to_numpy() != table.column("cell_b").to_numpy())[own]
            a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            for i, j in linked_pairs(fp, owner[own], max_bits):
                ok = ~split[i] | (side[i] != side[j])
                a, b = pairing.stars(np.concatenate([a, fp[i[ok]]]), np.concatenate([b, fp[j[ok]]]))
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], schema=schema)

    return cells.mapInArrow(run, "a long, b long")


def with_roots(nodes: DataFrame, max_bits: int) -> DataFrame:
    """``nodes`` (distinct fp, least) with the root of each one's component."""
    nodes = written(nodes, "nodes")
    found = components(links(nodes, max_bits))
    return written(nodes.join(found, nodes.fp == found.node, "left")
                        .select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint hex, component_id) of every row of ``docs``.

    component_id is the smallest id among all documents reachable by links of
    at most ``max_bits`` bits.  Null and empty texts have fingerprint zero and
    link like any other; null ids never become a component's id (null if a
    component has no other); repeated rows each get a row; an empty table
    gives an empty result; extra columns are ignored.
    """
    prints = written(fingerprints(docs, id_col, text_col, k), "fingerprints")
    roots = with_roots(prints.groupBy("fp").agg(F.min("id").alias("least")), max_bits)
    least = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = written(roots.join(least, "root").select("fp", "component_id"), "classes")
    return prints.join(classes, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             k: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of ``docs`` for each component: the one with the smallest id
    (null ids last), among rows of that id the one with the smallest digest of
    its columns.  Rows of equal ids and unlike texts, and rows without an id,
    are told apart by the digest; of rows equal in all columns one stays.
    Null and empty texts are one component; columns of any name stay; an empty
    table stays empty; a very long text is read whole."""
    row, = free_names(docs, "row_digest")
    rows = docs.withColumn(row, F.unhex(F.sha2(F.to_json(F.struct(*docs.columns)), 256)))
    prints = written(fingerprints(rows.select(F.col(id_col), F.col(text_col), F.col(row).alias("row_key")), id_col, text_col, k, ("row_key",)), "fingerprints")
    copies = prints.groupBy("fp", "id", "row_key").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row_key", "n")).alias("least")
    roots = with_roots(copies.groupBy("fp").agg(first), max_bits)
    chosen = written(roots.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.row_key").alias(row), F.col("least.n").alias("n")), "chosen")
    once, often = (rows.join(written(chosen.where(n).select(row), "chosen-rows"), row, "left_semi").select(docs.columns)
                   for n in ("n = 1", "n > 1"))
    return once.unionByName(often.dropDuplicates())
