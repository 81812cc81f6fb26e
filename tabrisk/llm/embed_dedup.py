"""Near-duplicate embeddings by E8 lattice hashing.

1. Equal vectors of a label are one class with a count, so exact copies are
   never compared.  Null, zero and non-finite vectors link with nothing.
2. Each of ``TABLES`` tables projects a unit vector at random to ``blocks``
   groups of 8 numbers and decodes each group to the nearest point of the E8
   lattice.  A class lies in the cell of its points, and also probes the
   ``PROBES`` nearest neighbouring cells of each group.  A label's number of
   groups grows with its own rows, so cells stay small, and its number of
   tables with its groups, so recall stays (``tables_for``).
3. Rows (cell, class, 128-bit sketch of signs) are dealt by cell; a cell with
   many rows is split into pair cells (``pair_cells``).  A task compares home
   rows with home and probing rows by their sketches and returns the sets of
   classes that may link; vectors stay where they are.
4. Sets that overlap are joined to one set as long as it is no larger than a
   cell may be, so a vector is mostly shuffled once, to its set; classes
   without a candidate are not shuffled at all.  Pairs of a set are verified
   by cosine in double precision, block by block; a pair in several sets
   counts in their smallest common one, so no pair is ever written.
5. Tasks return, by class, the number of vectors linked, and stars with the
   linked components; connected components give component_id.
"""

from __future__ import annotations

import itertools
import math
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.llm import pairing, textscan
from tabrisk.llm.spark_util import components, pair_cells, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COSINE = 0.93
TABLES, PROBES = 4, 2
#: Lattice scale against projections of unit variance.
SCALE = 2.4
#: Rows of a label that one more group of 8 numbers spreads.
SPREAD = 4096
SEED = 20240
#: Two words of signs; pairs at the limit differ in more bits than the sketch
#: limit with a probability of about 1 in 30,000 (four deviations).
SKETCH_BITS, SKETCH_DEVIATIONS = 128, 4.0
#: Rows of a set from which it is split; rows compared at a time.  A cell of
#: sketches may hold ``SKETCH_ROWS`` times as many.
CELL_ROWS, SKETCH_ROWS, BLOCK = 2048, 8, 512


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    pairs = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in itertools.combinations(range(8), 2) for a in (1, -1) for b in (1, -1)]
    halves = [np.array(s) / 2 for s in itertools.product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(pairs + halves)


def decode(x: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row of 8 numbers: the nearer of the best
    point of D8 (integers of even sum) and of D8 shifted by a half."""
    def even(y):
        r = np.rint(y)
        odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
        if len(odd):
            off = y[odd] - r[odd]
            k = np.abs(off).argmax(axis=1)
            r[odd, k] += np.where(off[np.arange(len(odd)), k] >= 0, 1, -1)
        return r
    a, b = even(x), even(x - 0.5) + 0.5
    nearer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(nearer[:, None], a, b)


def tables_for(blocks: int, tables: int = TABLES) -> int:
    """Tables of a label with so many groups.  A pair at the limit meets in a
    table with probability 0.86, 0.56, 0.32, 0.18 for 1 to 4 groups, so 4, 9,
    18, 36 tables find 0.999 of such pairs."""
    return tables if blocks == 1 else math.ceil(tables * 2.25 * 2 ** (blocks - 2))


def cell_keys(unit: np.ndarray, label_key: int, tables: int, blocks: int, probes: int, scale: float, seed: int):
    """Home cells [row, table] and probed cells [row, table, blocks * probes],
    as 64-bit keys, of unit vectors of one label."""
    n, dim = unit.shape
    directions = np.random.default_rng([seed, dim]).standard_normal((tables, blocks, dim, 8))
    steps = minimal_vectors()
    weights = textscan.mix(np.arange(1, tables * blocks * 8 + 1, dtype=np.uint64)).reshape(tables, blocks, 8) | np.uint64(1)
    home, probed = np.zeros((n, tables), np.uint64), np.zeros((n, tables, blocks * probes), np.uint64)
    own = textscan.mix(np.array([label_key % (1 << 64)], np.uint64))[0]
    for t in range(tables):
        sums, moves = np.zeros(n, np.uint64), np.zeros((n, blocks * probes), np.uint64)
        for b in range(blocks):
            x = unit @ directions[t, b] / scale
            point = decode(x)
            sums += ((2 * point).astype(np.int64).astype(np.uint64) * weights[t, b]).sum(axis=1, dtype=np.uint64)
            if probes:
                gain = (x - point) @ steps.T
                best = np.argpartition(-gain, probes, axis=1)[:, :probes]
                change = ((2 * steps).astype(np.int64).astype(np.uint64) * weights[t, b]).sum(axis=1, dtype=np.uint64)
                moves[:, b * probes: (b + 1) * probes] = change[best]
        salt = textscan.mix(np.array([t + 1], np.uint64))[0]
        home[:, t] = textscan.mix(sums ^ own ^ salt)
        probed[:, t] = textscan.mix((sums[:, None] + moves) ^ own ^ salt)
    return home, probed


def unit_rows(flat: np.ndarray, n: int) -> np.ndarray:
    """n vectors in double precision, each of length one."""
    v = flat.astype(np.float64).reshape(n, -1)
    v /= np.abs(v).max(axis=1, keepdims=True)  # squares of large numbers would overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def number_type(vectors: DataFrame, vector_col: str):
    """NumPy type of the vectors' numbers: float32 as it is, all else as float64."""
    return np.float32 if vectors.schema[vector_col].dataType.elementType.simpleString() == "float" else np.float64


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, digest, vec binary or null): the digest names a
    vector's exact content."""
    number = number_type(vectors, vector_col)

    def run(batches):
        for batch in batches:
            column = batch.column(2)
            out = []
            for x in column:
                v = None
                if x.is_valid and len(x.values) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False).astype(number) + number(0)
                    if not np.isfinite(v).all() or not v.any():
                        v = None
                out.append(None if v is None else v.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["id", "label", "vec"])

    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (id_col, label_col)}
    out = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    out = out.mapInArrow(run, f"id {kinds[id_col]}, label {kinds[label_col]}, vec binary")
    return out.withColumn("vec", F.when(F.col("label").isNotNull(), F.col("vec"))).withColumn("digest", F.md5("vec"))


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    """The signs of ``SKETCH_BITS`` random projections of unit vectors, as words [row, 2]."""
    directions = np.random.default_rng([seed, unit.shape[1], SKETCH_BITS]).standard_normal((unit.shape[1], SKETCH_BITS))
    return np.packbits(unit @ directions >= 0, axis=1).view(np.uint64)


def sketch_limit(cosine: float) -> int:
    """Differing bits up to which a pair at the limit is looked for."""
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    return math.floor(SKETCH_BITS * p + SKETCH_DEVIATIONS * math.sqrt(SKETCH_BITS * p * (1 - p)))


def keyed_rows(classes: DataFrame, number, tables: int, probes: int, scale: float, seed: int) -> DataFrame:
    """One row for each class, table and cell that it lies in or probes:
    (key, home, cls, s0, s1), with the sketch in s0 and s1.  ``classes`` has
    its label's groups (blocks)."""
    def run(batches):
        for batch in batches:
            vecs = [np.frombuffer(x.as_py(), number) for x in batch.column(2)]
            label, blocks = batch.column(1).to_numpy(), batch.column(3).to_numpy()
            group = {}
            for i, v in enumerate(vecs):
                group.setdefault((int(label[i]), len(v), int(blocks[i])), []).append(i)
            for (own, dim, groups), rows in group.items():
                count = tables_for(groups, tables)
                some = max(16, 32768 // (count * (1 + groups * probes)))  # at most about 32,768 copies at a time
                for k in range(0, len(rows), some):
                    at = np.array(rows[k: k + some])
                    unit = unit_rows(np.stack([vecs[i] for i in at]), len(at))
                    home, probed = cell_keys(unit, own * 1000003 + dim, count, groups, probes, scale, seed)
                    every = np.concatenate([home[:, :, None], probed], axis=2)
                    words = sketches(unit, seed).view(np.int64)
                    take = np.repeat(np.arange(len(at)), every[0].size)
                    is_home = np.tile(np.arange(every.shape[2]) == 0, len(at) * count)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(every.reshape(-1).view(np.int64)), pa.array(is_home), batch.column(0).take(pa.array(at[take])),
                         pa.array(words[take, 0]), pa.array(words[take, 1])], names=["key", "home", "cls", "s0", "s1"])

    return classes.select("cls", F.xxhash64("label").alias("l"), "vec", "blocks").mapInArrow(
        run, "key long, home boolean, cls long, s0 long, s1 long")


def blocks_of(n: int):
    """Blocks (i, j), i <= j, of the pairs of n rows."""
    return ((i, j) for i in range(0, n, BLOCK) for j in range(i, n, BLOCK))


def candidate_sets(rows: DataFrame, limit: int, cell_rows: int) -> DataFrame:
    """(set, cls, least): classes whose sketches differ by at most ``limit``
    bits in a cell are in one set, named by its members, so that the same
    classes found in several cells are one set.  A split cell is one set, by
    its key.  least: a class that ``cls`` may be linked with, or itself."""
    names = ["key", "cell_a", "cell_b"]
    cells = pair_cells(rows, ["key"], "cls", cell_rows).repartition(*names).sortWithinPartitions(*names, "cls")

    def run(batches):
        for table in pairing.whole_groups(batches, names, 1 << 15):
            key = table.column("key").to_numpy().view(np.uint64)
            home = table.column("home").to_numpy(zero_copy_only=False)
            cls, side = table.column("cls").to_numpy(), table.column("side").to_numpy()
            s0, s1 = (table.column(x).to_numpy().view(np.uint64) for x in ("s0", "s1"))
            split = (table.column("cell_a").to_numpy() != 0) | (table.column("cell_b").to_numpy() != 0)
            crossed = table.column("cell_a").to_numpy() != table.column("cell_b").to_numpy()
            starts = pairing.group_starts(table, names)
            sets, members, least = [], [], []
            for s, e in zip(starts, np.append(starts[1:], table.num_rows)):
                if e - s < 2 or not home[s:e].any():
                    continue
                ea, eb = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for i, j in blocks_of(e - s):
                    p, q = slice(s + i, min(s + i + BLOCK, e)), slice(s + j, min(s + j + BLOCK, e))
                    differ = np.bitwise_count(s0[p, None] ^ s0[q]) + np.bitwise_count(s1[p, None] ^ s1[q])
                    near = (differ <= limit) & (home[p, None] | home[q])
                    if crossed[s]:
                        near &= side[p, None] != side[q]
                    x, y = np.nonzero(near)
                    x, y = cls[p][x], cls[q][y]
                    ok = x < y  # rows are sorted by class
                    if ok.any():
                        ea, eb = pairing.stars(np.concatenate([ea, x[ok]]), np.concatenate([eb, y[ok]]))
                if not len(ea):
                    continue
                root, place = np.unique(eb, return_inverse=True)
                node = np.concatenate([ea, root])
                top = np.concatenate([eb, root])
                if split[s]:
                    name = np.full(len(node), key[s])
                else:
                    sums = textscan.mix(root.view(np.uint64))
                    np.add.at(sums, place, textscan.mix(ea.view(np.uint64)))
                    name = textscan.mix(sums)[np.concatenate([place, np.arange(len(root))])]
                sets.append(name.view(np.int64))
                members.append(node)
                least.append(top)
            none = [np.zeros(0, np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or none)) for x in (sets, members, least)],
                                             names=["set", "cls", "least"])

    return cells.mapInArrow(run, "set long, cls long, least long")


def joined_sets(found: DataFrame, cell_rows: int) -> DataFrame:
    """(cls, sets): the sets of each class.  Overlapping sets become one, named
    by its root, where that has at most ``cell_rows`` classes; else they stay
    as found, so a long chain of sets costs no comparison of its ends.  A class
    has no more sets than cells."""
    roots = components(found.select(F.col("cls").alias("a"), F.col("least").alias("b")))
    sizes = roots.groupBy("root").count()
    small = written(roots.join(sizes, "root").select(F.col("node").alias("cls"), F.when(F.col("count") <= cell_rows, F.col("root")).alias("root")), "set-roots")
    named = found.select("set", "cls").distinct().join(small, "cls").select("cls", F.coalesce("root", "set").alias("set"))
    return named.groupBy("cls").agg(F.sort_array(F.collect_set("set")).alias("sets"))


def first_common(a: np.ndarray, b: np.ndarray, key) -> np.ndarray:
    """Whether ``key`` is the first common entry of each pair of rows of a and
    b (ascending, filled up with the key, which both have)."""
    first = np.ones(len(a), bool)
    for k in range(a.shape[1]):
        first &= (a[:, k] >= key) | ~(b == a[:, k, None]).any(axis=1)
    return first


def near_pairs(rows: DataFrame, number, cosine: float, cell_rows: int) -> DataFrame:
    """(a, b, n): with b null, class a is linked to n more vectors; else a and
    b lie in one component.  ``rows``: (key, cls, n, sets, vec), one for each set (key) of a class."""
    names = ["key", "cell_a", "cell_b"]
    cells = pair_cells(rows, ["key"], "cls", cell_rows).repartition(*names).sortWithinPartitions(*names, "cls")

    def compare(table):
        key, cls, n, side = (table.column(x).to_numpy() for x in ("key", "cls", "n", "side"))
        crossed = table.column("cell_a").to_numpy() != table.column("cell_b").to_numpy()
        starts = pairing.group_starts(table, names)
        vec, sets = table.column("vec").combine_chunks(), table.column("sets").combine_chunks()
        n_sets = pc.list_value_length(sets).to_numpy()
        degree_a, degree_n, ea, eb = [], [], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for s, e in zip(starts, np.append(starts[1:], table.num_rows)):
            dims = pc.binary_length(vec.slice(s, e - s)).to_numpy()
            if e - s < 2 or (dims != dims[0]).any():  # unequal lengths never meet but by a hash's accident
                continue
            unit = unit_rows(np.frombuffer(b"".join(vec.slice(s, e - s).to_pylist()), number), e - s)
            own = None
            if (n_sets[s:e] > 1).any():
                own = np.full((e - s, int(n_sets[s:e].max())), key[s])
                own[np.arange(own.shape[1]) < n_sets[s:e, None]] = sets.slice(s, e - s).flatten().to_numpy()
            sums = np.zeros(e - s, np.int64)
            for i, j in blocks_of(e - s):
                near = unit[i: i + BLOCK] @ unit[j: j + BLOCK].T >= cosine
                if crossed[s]:
                    near &= side[s + i: min(s + i + BLOCK, e), None] != side[s + j: min(s + j + BLOCK, e)]
                x, y = np.nonzero(near)
                x, y = x + i, y + j
                ok = cls[s + x] < cls[s + y]  # rows are sorted by class
                x, y = x[ok], y[ok]
                if own is not None:
                    parts = [first_common(own[x[k: k + (1 << 13)]], own[y[k: k + (1 << 13)]], key[s]) for k in range(0, len(x), 1 << 13)]
                    ok = np.concatenate(parts) if parts else np.zeros(0, bool)
                    x, y = x[ok], y[ok]
                if not len(x):
                    continue
                sums += np.bincount(x, n[s + y], e - s).astype(np.int64) + np.bincount(y, n[s + x], e - s).astype(np.int64)
                ea, eb = pairing.stars(np.concatenate([ea, cls[s + x]]), np.concatenate([eb, cls[s + y]]))
            some = np.flatnonzero(sums)
            degree_a.append(cls[s + some])
            degree_n.append(sums[some])
        a = np.concatenate([*degree_a, ea]).astype(np.int64)
        b = pa.array(np.concatenate([np.zeros(len(a) - len(eb), np.int64), eb]), mask=np.arange(len(a)) < len(a) - len(eb))
        n = np.concatenate([*degree_n, np.zeros(len(ea), np.int64)]).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(n)], names=["a", "b", "n"])

    def run(batches):
        for table in pairing.whole_groups(batches, names, 1 << 13):
            yield compare(table)

    return cells.mapInArrow(run, "a long, b long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE,
                    seed: int = SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(id, n_links, component_id, kept) of every row of ``vectors``.

    Vectors link if their labels are equal and not null and their cosine is at
    least ``cosine``; the lattice finds nearly all such pairs (see the tests
    for recall) whatever the sizes of the labels, and never adds one.  Equal vectors always link.  A vector that
    is null, empty or zero, or holds null or non-finite numbers, or has a null
    label, links with nothing: n_links 0, component_id its own id.  Vectors of
    unequal length don't link.  Repeated rows count as vectors of their own; a
    null id is never a component's id.  Extra columns are ignored; an empty
    table gives no row.
    """
    rows = written(usable(vectors, id_col, vector_col, label_col), "vectors")
    number = number_type(vectors, vector_col)
    good = rows.where("vec is not null")
    classes = (good.groupBy("label", "digest").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("vec").alias("vec"))
                   .withColumn("cls", F.monotonically_increasing_id()))
    classes = written(classes, "classes")
    groups = F.ceil(F.log("count") / math.log(SPREAD) - 1 / 3).cast("int")  # two from 65,536 rows
    large = written(classes.groupBy("label").count().select("label", groups.alias("blocks")).where("blocks > 1"), "large-labels")
    grouped = classes.join(large, "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    keyed = keyed_rows(grouped, number, tables, probes, scale, seed)
    sets = joined_sets(written(candidate_sets(keyed, sketch_limit(cosine), SKETCH_ROWS * cell_rows), "candidate-sets"), cell_rows)
    dealt = (written(sets, "class-sets").join(classes.select("cls", "n", "vec"), "cls")
             .select(F.explode("sets").alias("key"), "cls", "n", "sets", "vec"))
    found = written(near_pairs(written(dealt, "set-rows"), number, cosine, cell_rows), "found")
    degree = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("linked"))
    roots = components(found.where("b is not null").select("a", "b"))
    facts = (classes.select("label", "digest", "least", "n", "cls").join(degree, "cls", "left")
                    .join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                    .withColumn("root", F.coalesce("root", "cls")))
    facts = written(facts, "facts")
    least = facts.groupBy("root").agg(F.min("least").alias("component_id"))
    facts = written(facts.join(least, "root").select(
        F.col("label").alias("_label"), F.col("digest").alias("_digest"),
        (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "component_id"), "class-facts")
    same = (F.col("label") == F.col("_label")) & (F.col("digest") == F.col("_digest"))
    linked = good.join(facts, same).select("id", "n_links", "component_id")
    alone = rows.where("vec is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
