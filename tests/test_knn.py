"""Cell-pruned KNN equals brute force; vote rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrisk.operators.knn import grid_votes, neighbours, vote


def _brute(train, query, k, metric, differ=None):
    out = {}
    for qid, qv, qf in query:
        ds = []
        for tid, tv, lab, tf in train:
            if differ and qf == tf:
                continue
            d = (float(np.sqrt(sum((a - b) ** 2 for a, b in zip(qv, tv)))) if metric == "euclidean"
                 else float(sum(abs(a - b) for a, b in zip(qv, tv))))
            ds.append((d, tid))
        out[qid] = [t for _, t in sorted(ds)[:k]]
    return out


@pytest.mark.parametrize("metric,k,cells,differ", [("euclidean", 5, None, False), ("manhattan", 9, 7, False),
                                                   ("euclidean", 3, 40, True)])
def test_neighbours_equal_brute_force(spark, metric, k, cells, differ):
    rnd = random.Random(11)
    train = [(i, [rnd.gauss(0, 1) for _ in range(4)], rnd.randint(0, 1), i % 3) for i in range(300)]
    query = [(1000 + i, [rnd.gauss(0, 1) for _ in range(4)], i % 3) for i in range(40)]
    t = spark.createDataFrame(train, "tid long, vec array<double>, label int, f int")
    q = spark.createDataFrame(query, "qid long, vec array<double>, f int")
    nb = neighbours(t, q, k, metric, cells=cells, differ_on="f" if differ else None)
    got = {}
    for r in nb.orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["tid"])
    assert got == _brute(train, query, k, metric, differ)
    # the same with feature columns instead of an array
    tc = t.select("tid", "label", "f", *[F.col("vec")[i].alias(f"c{i}") for i in range(4)])
    qc = q.select("qid", "f", *[F.col("vec")[i].alias(f"c{i}") for i in range(4)])
    nb2 = neighbours(tc, qc, k, metric, vec=[f"c{i}" for i in range(4)], cells=cells,
                     differ_on="f" if differ else None)
    got2 = {}
    for r in nb2.orderBy("qid", "rank").collect():
        got2.setdefault(r["qid"], []).append(r["tid"])
    assert got2 == got


def test_plan_has_no_cartesian_product(spark):
    t = spark.createDataFrame([(i, [float(i), 0.0], i % 2) for i in range(50)], "tid long, vec array<double>, label int")
    q = spark.createDataFrame([(i, [float(i) + 0.5, 0.0]) for i in range(5)], "qid long, vec array<double>")
    plan = neighbours(t, q, 3)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_zero_distance_takes_all_weight_and_ties_go_to_zero(spark):
    nb = spark.createDataFrame([(1, 10, 0.0, 1, 1), (1, 11, 0.5, 0, 2), (1, 12, 0.7, 0, 3),
                                (2, 10, 1.0, 1, 1), (2, 11, 1.0, 0, 2)],
                               "qid long, tid long, dist double, t_label int, rank int")
    d = {r["qid"]: (r["prediction"], r["probability"]) for r in vote(nb, 3, "distance").collect()}
    assert d[1] == (1, 1.0)
    u = {r["qid"]: (r["prediction"], r["probability"]) for r in vote(nb, 2, "uniform").collect()}
    assert u[2] == (0, 0.5)                       # vote tie -> class 0
    g = {(r["qid"], r["k"], r["weights"]): r["prediction"] for r in grid_votes(nb, [1, 3]).collect()}
    assert g[(1, 1, "uniform")] == 1 and g[(1, 3, "uniform")] == 0 and g[(1, 3, "distance")] == 1


def test_splits_blocks_copies_and_bad_coordinates(spark, monkeypatch):
    """Cells and query sets beyond a block are split, copies tie by id, and
    clustered data leaves most cells out."""
    from tabrisk.operators import knn
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 50, (6, 5))
    at = rnd.integers(0, 6, 240)
    vs = (centres[at] + rnd.normal(0, 1, (240, 5))).tolist()
    for i in range(80):
        vs[i] = vs[0]                                           # a third are copies
    train = [(i, v, i % 2, 0) for i, v in enumerate(vs)]
    query = [(1000 + i, v, 1) for i, v in enumerate(vs[70:130])]
    t = spark.createDataFrame(train, "tid long, vec array<double>, label int, f int").drop("f")
    q = spark.createDataFrame(query, "qid long, vec array<double>, f int").drop("f")
    got = {}
    for r in neighbours(t, q, 7).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["tid"])
    assert got == _brute(train, query, 7, "euclidean")
    assert not neighbours(t.where("tid < 0"), q, 7).collect()
    assert neighbours(t.where("tid < 3"), q, 7).count() == 3 * len(query)
    bad = q.unionByName(spark.createDataFrame([(1, [1.0, None, 0.0, 0.0, 0.0])], "qid long, vec array<double>"))
    with pytest.raises(Exception, match="coordinate is null"):
        neighbours(t, bad, 7).collect()


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
@pytest.mark.parametrize("scale", [1.0, 1e-9, 1e6, 1e30])
def test_candidates_hold_the_nearest_and_are_few(metric, scale):
    """Random vectors without clusters: all true neighbours are candidates, and
    few pairs get a full distance; far too large numbers fall back to all."""
    from tabrisk.operators.knn import _nearest, candidates, pair_distances
    rng = np.random.default_rng(3)
    t, q = rng.normal(5, 1, (2000, 64)) * scale, rng.normal(5, 1, (50, 64)) * scale
    t[100:120] = t[0]                                   # repeated rows tie
    d = pair_distances(q, t, metric)
    r, c, got = _nearest(q, t, 15, metric)
    for i in range(len(q)):
        want = np.lexsort((np.arange(len(t)), d[i]))[:15]
        assert c[r == i].tolist() == want.tolist() and np.array_equal(got[r == i], d[i][want])
    share = len(candidates(q, t, 15, metric)[0]) / d.size
    assert share < 0.05 or scale == 1e30


def test_share_of_full_distances_on_the_embeddings(spark):
    from tabrisk.operators.knn import candidates
    from tabrisk.plans.knn_queries import _scaled_split
    train, test = _scaled_split(spark, "/root/testdata/sf0.01")
    t, q = (np.array([r["vec"] for r in df.select("vec").collect()]) for df in (train, test))
    for metric in ("euclidean", "manhattan"):
        assert len(candidates(q, t, 31, metric)[0]) / (len(t) * len(q)) < 0.3


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_a_block_leaves_only_rows_within_the_known_distance(metric):
    """The second phase doesn't write k rows for every cell a query reaches."""
    import pyarrow as pa

    from tabrisk.operators.knn import _block_kernel, pair_distances
    rng = np.random.default_rng(8)
    q, t = rng.normal(0, 1, (30, 6)), rng.normal(0, 1, (400, 6))
    d = pair_distances(q, t, metric)
    best = np.sort(d, axis=1)[:, 2]                         # the bound is met by three rows exactly
    best[0] = np.inf
    ask = pa.table({"qid": pa.array(range(30)), "_qv": pa.array(list(q)), "_best": pa.array(best)})
    rows = pa.table({"_tid": pa.array(range(400)), "_tv": pa.array(list(t)), "t_label": pa.array([0] * 400, pa.int32())})
    got = _block_kernel(9, metric, ["qid"], False)(ask, rows).to_pandas()
    for i in range(30):
        want = np.argsort(d[i], kind="stable")[: 9 if i == 0 else 3]
        assert got[got.qid == i]._tid.tolist() == want.tolist()


def _shuffled(spark):
    """Bytes of shuffle files that the session has."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_rows_are_not_written_for_each_pair_of_blocks(spark, monkeypatch):
    """Data without clusters: every query reaches all 40 cells; neither its
    vector nor a training row is shuffled for each of them."""
    from tabrisk.operators import knn
    monkeypatch.setattr(knn, "CELL_ROWS", 16)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 32)], i % 2) for i in range(640)]
    t = spark.createDataFrame(rows, "tid long, vec array<double>, label int")
    q = t.select((F.col("tid") + 1000).alias("qid"), "vec")
    before = _shuffled(spark)
    assert neighbours(t, q, 3).count() == 3 * 640
    assert _shuffled(spark) - before < 8 * 640 * 32 * 8


def test_ids_of_any_type_and_rows_of_equal_keys(spark):
    """Text ids tie in their order, a null one before; queries of one key are
    one, with the nearest of all of them; groups without training rows get none."""
    t = spark.createDataFrame([("b", [1.0], 1, 0), ("a", [1.0], 0, 0), (None, [1.0], 1, 0), ("c", [5.0], 1, 0), ("d", [1.0], 1, 1)],
                              "tid string, vec array<double>, label int, g int")
    q = spark.createDataFrame([("x", [1.0], 0), ("x", [5.0], 0), (None, [4.0], 0), ("y", [0.0], 2), ("z", [0.0], 1)],
                              "qid string, vec array<double>, g int")
    got = {}
    for r in neighbours(t, q, 4, same_on=("g",)).orderBy("qid", "rank").collect():
        got.setdefault((r["qid"], r["g"]), []).append((r["dist"], r["tid"], r["t_label"]))
    assert got == {("x", 0): [(0.0, None, 1), (0.0, "a", 0), (0.0, "b", 1), (0.0, "c", 1)],
                   (None, 0): [(1.0, "c", 1), (3.0, None, 1), (3.0, "a", 0), (3.0, "b", 1)], ("z", 1): [(1.0, "d", 1)]}
