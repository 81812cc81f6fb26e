"""Exact k-nearest neighbours by cells, without pair rows.

Cells
-----
Centres are a bounded sample of training vectors (about one for each
``CELL_ROWS`` rows, at most ``MAX_CENTRES``).  A training row belongs to its
nearest centre's cell; a cell's radius is its largest distance to the
centre.  A cell of at least k rows bounds a query's k-th distance by
d(query, centre) + radius.  Rows are packed into blocks by cell, queries
likewise by their nearest one.

A query block meets all training blocks of its variant as a stream
(``operators.pairs``): neither side is copied for a pair or shuffled again.  By
the triangle inequality no row of a block is nearer to a query than d(query,
mean) - radius of the block, so only the queries whose k-th distance so far
(at first the cells' bound) reaches it are compared with its rows.

The kernel first takes all distances of two blocks in single precision, the
Euclidean ones as one matrix product, with a bound on their error; only pairs
whose lower bound is within the k-th upper bound of their query get a full
distance in double precision, which on data without clusters is a few per cent
of them.  A task keeps the k best of each query by (distance, training id), one
row a query, so no pair is ever a row.  The result
is exact whatever the cells are, and distances are summed left to right in
double precision.  On data without clusters the cells prune little and the
cost is the blocked single-precision product of queries and training rows.

Null, NaN or infinite coordinates raise an error (impute first); an empty
training table gives no neighbours.

Votes (E6): uniform or 1/distance weights; when a query has neighbours at
distance 0 those alone vote; class = larger weight, ties to class 0;
probability = weight share of class 1.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.operators.pairs import TASKS_PER_CORE, all_pairs, from_bytes, pack, slices_for
from tabrisk.session import cut_lineage

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no install

CELL_ROWS = 4096        # rows of a block on either side
MAX_CENTRES = 1024      # bound of the centre table that is sent to the executors
CHUNK = 1 << 18         # distances held at once by the kernel


def pair_distances(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """len(a) x len(b) distances, summed dimension by dimension."""
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T):
        d = x[:, None] - y[None, :]
        out += d * d if metric == "euclidean" else np.abs(d)
    return np.sqrt(out) if metric == "euclidean" else out


def _matrix(column: pa.ChunkedArray | pd.Series) -> np.ndarray:
    """Rows of a list column as a matrix; anything but finite numbers is an error."""
    if isinstance(column, pd.Series):
        m = np.array(column.tolist(), dtype=float)
    else:
        flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
        m = flat.to_numpy(zero_copy_only=False).astype(float)
        m = m.reshape(len(column), -1) if len(column) else m.reshape(0, 0)
    if not np.isfinite(m).all():
        raise ValueError("neighbours: a coordinate is null, NaN or infinite; impute it first")
    return m


def candidates(q: np.ndarray, t: np.ndarray, k: int, metric: str, apart: np.ndarray | None = None,
               within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of q, row of t) of all pairs that can be among the k nearest of
    their query, from single-precision distances and their error bounds;
    pairs of ``apart`` are left out, and those certainly beyond the query's
    distance ``within``."""
    mean = t.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        a, b = (q - mean).astype(np.float32), (t - mean).astype(np.float32)
        na, nb = ((a * a).sum(axis=1), (b * b).sum(axis=1)) if metric == "euclidean" else (np.abs(a).sum(axis=1), np.abs(b).sum(axis=1))
        # rounding of the inputs and of a sum of as many terms
        share = np.float32((q.shape[1] + 8) * 2.0 ** -22)
        if not np.isfinite(4 * (na.max(initial=0) + nb.max(initial=0))):     # too large for single precision: every pair
            return np.nonzero(np.ones((len(q), len(t)), bool) if apart is None else ~apart)
        # low: a distance (squared, if Euclidean) less its error; with twice the error it is an upper bound
        if metric == "euclidean":
            low = (a * np.float32(-2)) @ b.T
            low += (na * (1 - share))[:, None]
            low += nb * (1 - share)
        else:
            low, part = (np.zeros((len(a), len(b)), np.float32) for _ in range(2))
            for x, y in zip(a.T, np.ascontiguousarray(b.T)):
                np.subtract(x[:, None], y, out=part)
                np.abs(part, out=part)
                low += part
            low -= (na * share)[:, None]
            low -= nb * share
    if apart is not None:
        low[apart] = np.inf
    near, kth = None, np.full(len(q), np.inf, np.float32)
    if within is not None:
        with np.errstate(over="ignore"):
            reach = (within * within if metric == "euclidean" else within) * (1 + 1e-6)
            kth = np.nextafter(reach.astype(np.float32), np.float32(np.inf))
        near = low <= kth[:, None]
    if near is None or np.count_nonzero(near) > 4 * k * len(q):
        at = min(k, low.shape[1]) - 1
        kth = np.minimum(kth, np.partition(low, at, axis=1)[:, at] + 2 * share * (na + nb.max(initial=0)) * np.float32(1 + 1e-6))
        near = low <= kth[:, None]
    if apart is not None:
        near &= ~apart
    return np.divmod(np.flatnonzero(near), max(1, len(t)))


def exact_distances(q: np.ndarray, t: np.ndarray, r: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Distances of the pairs (q[r], t[c]), summed dimension by dimension in double precision."""
    out = np.zeros(len(r))
    for x, y in zip(q.T, t.T):
        d = x[r] - y[c]
        out += d * d if metric == "euclidean" else np.abs(d)
    return np.sqrt(out) if metric == "euclidean" else out


def _nearest(q: np.ndarray, t: np.ndarray, k: int, metric: str, apart: np.ndarray | None = None, within: np.ndarray | None = None):
    """(row, column, distance) of the k nearest rows of t of each row of q, not
    farther than ``within``, ties to the smaller column."""
    r, c = candidates(q, t, k, metric, apart, within)
    d = exact_distances(q, t, r, c, metric)
    if within is not None:
        near = d <= within[r]
        r, c, d = r[near], c[near], d[near]
    order = np.lexsort((c, d, r))
    r, c, d = r[order], c[order], d[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < k], c[rank < k], d[rank < k]


def _block_kernel(k: int, metric: str, keys: list[str], differ: bool):
    """(query block, training block) -> at most k rows for each query."""

    def run(q: pa.Table, t: pa.Table) -> pa.Table:
        rows, cols, dist = [np.empty(0, int)], [np.empty(0, int)], [np.empty(0)]
        if q.num_rows and t.num_rows:
            t = t.sort_by("_tid")
            tv, qv = _matrix(t["_tv"]), _matrix(q["_qv"])
            best = q["_best"].to_numpy()
            step = max(1, CHUNK // len(tv))
            for i in range(0, len(qv), step):
                apart = q["_qf"].to_numpy()[i:i + step, None] == t["_tf"].to_numpy()[None, :] if differ else None
                r, c, d = _nearest(qv[i:i + step], tv, k, metric, apart, best[i:i + step])
                rows.append(r + i), cols.append(c), dist.append(d)
        r, c = np.concatenate(rows), np.concatenate(cols)
        out = q.select(keys).take(r)
        return (out.append_column("_tid", t["_tid"].take(c)).append_column("dist", pa.array(np.concatenate(dist)))
                .append_column("t_label", t["t_label"].take(c)))

    return run


class _Near:
    """The k best of each row of a query block, by (distance, training id)."""

    def __init__(self, q: pa.Table, k: int, metric: str, differ: bool, plain: bool):
        n = q.num_rows
        self.q, self.k, self.metric, self.plain = q.append_column("_row", pa.array(np.arange(n))), k, metric, plain
        self.vec, self.best = _matrix(q["_qv"]), q["_best"].to_numpy().copy()
        self.kernel = _block_kernel(k, metric, ["_row"], differ)
        self.dist, self.label = np.full((n, k), np.inf), np.full((n, k), np.nan)
        self.tid = np.zeros((n, k), np.int64) if plain else _objects([(2,)] * (n * k)).reshape(n, k)
        self.free = np.ones((n, k), bool)

    def meet(self, t: pa.Table) -> None:
        tv = _matrix(t["_tv"])
        if self.vec.size and tv.shape[1] != self.vec.shape[1]:
            raise ValueError("neighbours: vectors of different lengths")
        centre = tv.mean(axis=0)[None, :]
        if np.isfinite(centre).all():
            far = pair_distances(self.vec, centre, self.metric)[:, 0] - pair_distances(tv, centre, self.metric).max()
            own = np.flatnonzero(~(far > self.best * (1 + 1e-9) + 1e-9))       # rounding never hides a block
        else:
            own = np.arange(len(self.vec))
        if not len(own):
            return
        ask = self.q.take(own) if len(own) < len(self.vec) else self.q
        ask = ask.set_column(ask.column_names.index("_best"), "_best", pa.array(self.best[own]))
        found = self.kernel(ask, t)
        row, dist, label = found["_row"].to_numpy(), found["dist"].to_numpy(), found["t_label"].to_numpy().astype(float)
        tid = found["_tid"].to_numpy().astype(np.int64) if self.plain else _objects(
            [(0,) if v is None else (1, v) for v in found["_tid"].to_pylist()])
        if not len(row):
            return
        # found rows of a query follow each other
        rows, first, count = np.unique(row, return_index=True, return_counts=True)
        at, place = np.repeat(np.arange(len(rows)), count), self.k + np.arange(len(row)) - np.repeat(first, count)
        wide = lambda old, fill: np.concatenate([old[rows], np.full((len(rows), count.max()), fill, old.dtype)], axis=1)
        d, lab, free = wide(self.dist, np.inf), wide(self.label, np.nan), wide(self.free, True)
        ids = wide(self.tid, 0) if self.plain else np.concatenate(
            [self.tid[rows], _objects([(2,)] * (len(rows) * count.max())).reshape(len(rows), -1)], axis=1)
        d[at, place], lab[at, place], ids[at, place], free[at, place] = dist, label, tid, False
        by = ids if self.plain else np.unique(ids, return_inverse=True)[1].reshape(ids.shape)
        order = np.lexsort((by, d, free), axis=1)[:, : self.k]
        for kept, new in ((self.dist, d), (self.label, lab), (self.tid, ids), (self.free, free)):
            kept[rows] = np.take_along_axis(new, order, axis=1)
        self.best[rows] = np.minimum(self.best[rows], self.dist[rows, -1])

    def result(self, keys: list[str], id_type: pa.DataType) -> pa.Table:
        have = ~self.free
        label = self.label[have]
        ids = self.tid[have] if self.plain else [v[1] if len(v) > 1 else None for v in self.tid[have]]
        each = pa.StructArray.from_arrays([pa.array(self.dist[have]), pa.array(ids, id_type),
                                           pa.array(np.nan_to_num(label).astype(np.int32), mask=np.isnan(label))], ["dist", "_tid", "t_label"])
        ends = np.append(0, np.cumsum(have.sum(axis=1))).astype(np.int32)
        return self.q.select(keys).append_column("_near", pa.ListArray.from_arrays(pa.array(ends), each))


def _objects(values: list) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = values
    return out


def _search(k: int, metric: str, keys: list[str], differ: bool, plain: bool):
    """Neighbours of each query block among the training blocks of its variant that follow."""
    def run(pairs):
        blocks, id_type = {}, None
        for q, t in pairs:
            if q["_g"] != t["_g"]:
                continue
            if q["_number"] not in blocks:
                blocks[q["_number"]] = _Near(from_bytes(q["_block"]), k, metric, differ, plain)
            rows = from_bytes(t["_block"])
            id_type = rows.schema.field("_tid").type
            blocks[q["_number"]].meet(rows)
        for block in blocks.values():
            yield block.result(keys, id_type)
    return run


def neighbours(train: DataFrame, query: DataFrame, k: int, metric: str = "euclidean",
               tid: str = "tid", qkeys: tuple[str, ...] = ("qid",), vec="vec",
               label: str = "label", same_on: tuple[str, ...] = (),
               differ_on: str | None = None, cells: int | None = None) -> DataFrame:
    """The k nearest training rows of every query row.

    ``vec`` is an array<double> column or a list of double columns.
    train: (tid, vec, label, *same_on [, differ_on]); query: (*qkeys, vec,
    *same_on[, differ_on]).  ``same_on`` columns must be equal in a pair (one
    run for many variants: fold statistics, removed feature); ``differ_on``
    must differ (training rows of the other folds).  ``cells`` overrides the
    number of centres.
    Output: (*qkeys, *same_on, tid, dist, t_label, rank)."""
    if metric not in ("euclidean", "manhattan"):
        raise ValueError(f"unknown metric {metric!r}")
    keys = [*qkeys, *[c for c in same_on if c not in qkeys]]
    x = F.array(*[F.col(c).cast("double") for c in vec]) if isinstance(vec, (list, tuple)) else F.col(vec)
    # "_g" stands for the variant: cells, splits and joins are made within it
    group = F.xxhash64(*[F.col(c) for c in same_on]) if same_on else F.lit(0).cast("long")
    tr = train.select(F.col(tid).alias("_tid"), x.alias("_tv"), F.col(label).cast("int").alias("t_label"),
                      group.alias("_g"), *([F.col(differ_on).alias("_tf")] if differ_on else []))
    qr = query.select(*keys, x.alias("_qv"), group.alias("_g"),
                      *([F.col(differ_on).alias("_qf")] if differ_on else []))
    schema = T.StructType([*[qr.schema[c] for c in keys], T.StructField("_tid", tr.schema["_tid"].dataType),
                           T.StructField("dist", T.DoubleType()), T.StructField("t_label", T.IntegerType())])
    # one pass; a variant has a row in no aggregate but the sizes of its cells
    n_train, no_id, n_groups = tr.agg(F.count(F.lit(1)), F.count_if(F.col("_tid").isNull()), F.countDistinct("_g")).first()
    if not n_train:
        return query.sparkSession.createDataFrame([], schema).select(
            *keys, F.col("_tid").alias(tid), "dist", "t_label", F.lit(1).alias("rank"))
    # cells are sized by the rows of a variant, not of all
    n_cells = min(MAX_CENTRES, max(1, cells or n_train // n_groups // CELL_ROWS))
    sample = tr.orderBy(F.xxhash64("_tid", "_g"), "_tid").limit(n_cells).select("_tv").collect()     # the centres
    centres = np.array([r[0] for r in sample], dtype=float)

    @F.pandas_udf("cell long, off double")
    def home(v: pd.Series) -> pd.DataFrame:
        d = pair_distances(_matrix(v), centres, metric)
        at = d.argmin(axis=1)
        return pd.DataFrame({"cell": at, "off": d[np.arange(len(d)), at]})

    homes = tr.withColumn("_h", home("_tv")).select("*", F.col("_h.cell").alias("_cell"), F.col("_h.off").alias("_off")).drop("_h")
    laid = homes.repartitionByRange("_g", "_cell", F.xxhash64("_tid", "_tv")).sortWithinPartitions("_g", "_cell")
    held = cut_lineage(pack(laid, ["_g", "_cell"], CELL_ROWS, largest="_off"))
    # at most MAX_CENTRES cells for each variant
    reach: dict = {}
    for g, cell, n, radius in held.groupBy("_g", "_cell").agg(F.sum("_n"), F.max("_largest")).collect():
        reach.setdefault(g, []).append((cell, n, radius))
    reach = {g: tuple(np.array(v) for v in zip(*sorted(found))) for g, found in reach.items()}

    @F.pandas_udf("cell long, best double")
    def start(v: pd.Series, g: pd.Series) -> pd.DataFrame:
        d = pair_distances(_matrix(v), centres, metric)
        out = pd.DataFrame({"cell": np.zeros(len(d), int), "best": np.full(len(d), np.inf)})
        for at in g.unique():
            if at in reach:
                own, (ids, n, radii) = np.flatnonzero(g == at), reach[at]
                near = d[np.ix_(own, ids)]
                out.loc[own, "cell"] = ids[near.argmin(axis=1)]
                full = n >= k
                if full.any() and differ_on is None:
                    out.loc[own, "best"] = (near + radii)[:, full].min(axis=1) * (1 + 1e-9) + 1e-9
        return out

    n_query = qr.count()
    cores = query.sparkSession.sparkContext.defaultParallelism
    most = min(4 * CELL_ROWS, max(1, CELL_ROWS // 4, -(-n_query // (TASKS_PER_CORE * cores))))
    asked = qr.withColumn("_h", start("_qv", "_g")).select("*", F.col("_h.cell").alias("_own"), F.col("_h.best").alias("_best")).drop("_h")
    asked = asked.repartitionByRange(max(1, -(-n_query // most)), "_g", "_own", F.xxhash64(*keys, "_qv")).sortWithinPartitions("_g", "_own")
    blocks = pack(asked, ["_g"], 2 * most)
    plain = isinstance(tr.schema["_tid"].dataType, T.IntegralType) and not no_id
    near = T.ArrayType(T.StructType([schema["dist"], schema["_tid"], schema["t_label"]]))
    found = all_pairs(blocks, held, _search(k, metric, keys, differ_on is not None, plain),
                      T.StructType([*[qr.schema[c] for c in keys], T.StructField("_near", near)]), slices_for(blocks, held))
    # queries of equal keys are one, with the nearest of all of them; so are the slices of a query
    merged = cut_lineage(found.groupBy(*keys).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_near")))
    return merged.select(*keys, F.posexplode("_near").alias("_r", "_n")).select(
        *keys, F.col("_n._tid").alias(tid), F.col("_n.dist").alias("dist"), F.col("_n.t_label").alias("t_label"), (F.col("_r") + 1).alias("rank"))


def vote(nb: DataFrame, k: int, weights: str = "uniform", keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """E6 on the neighbour table: (keys, prediction, probability) using the
    neighbours of rank <= k."""
    top = nb.where(F.col("rank") <= k)
    return _vote(top.groupBy(*keys), weights).select(*keys, "prediction", "probability")


def _vote(grouped, weights: str):
    lab, d = F.col("t_label"), F.col("dist")
    agg = grouped.agg(
        F.count(F.lit(1)).alias("_n"), F.sum(lab).alias("_n1"),
        F.sum(F.when(d == 0, 1).otherwise(0)).alias("_z"),
        F.sum(F.when(d == 0, lab).otherwise(0)).alias("_z1"),
        F.sum(F.when(d > 0, 1.0 / d).otherwise(0.0)).alias("_w"),
        F.sum(F.when(d > 0, lab / d).otherwise(0.0)).alias("_w1"))
    if weights == "uniform":
        p1 = F.col("_n1") / F.col("_n")
    elif weights == "distance":
        p1 = F.when(F.col("_z") > 0, F.col("_z1") / F.col("_z")).otherwise(F.col("_w1") / F.col("_w"))
    else:
        raise ValueError(f"unknown weights {weights!r}")
    return agg.withColumn("probability", p1).withColumn(
        "prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0))


def grid_votes(nb: DataFrame, ks: list[int], keys: tuple[str, ...] = ("qid",)) -> DataFrame:
    """Every k of a grid and both weightings from ONE neighbour table: a
    neighbour of rank r votes for every k >= r (explode over the grid), one
    aggregate gives both weightings."""
    keys = list(keys)
    grid = F.array(*[F.lit(int(x)) for x in sorted(ks)])
    ex = nb.withColumn("k", F.explode(F.filter(grid, lambda x: x >= F.col("rank"))))
    agg = _vote(ex.groupBy(*keys, "k"), "uniform").withColumnRenamed("probability", "p_uniform")
    lab, d = F.col("_z1"), F.col("_z")
    p_dist = F.when(d > 0, lab / d).otherwise(F.col("_w1") / F.col("_w"))
    both = F.array(
        F.struct(F.lit("uniform").alias("weights"), F.col("p_uniform").alias("probability")),
        F.struct(F.lit("distance").alias("weights"), p_dist.alias("probability")))
    return (agg.select(*keys, "k", F.inline(both))
               .withColumn("prediction", F.when(F.col("probability") > 0.5, 1).otherwise(0)))
