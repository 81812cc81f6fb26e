import numpy as np
import pytest

from tabrisk.operators.variants import PLAIN, smallest, variant_accuracy
from tabrisk.plans.knn_queries import with_donors


def brute(train, query, ks, repeats):
    """(feature, rep, k) -> right answers, by whole distances of copied rows."""
    t = np.array([r[1] for r in train])
    labels, out = np.array([r[2] for r in train]), {}
    order = np.argsort([r[0] for r in train])
    t, labels = t[order], labels[order]
    for qid, vec, actual, donors in query:
        variants = [(PLAIN, 0, vec)]
        for f in range(len(vec)):
            for r in range(repeats or 1):
                new = list(vec)
                new[f] = donors[f * repeats + r] if repeats else None
                variants.append((f, r, new))
        for f, r, v in variants:
            keep = [i for i, x in enumerate(v) if x is not None]
            d = sum((t[:, i] - v[i]) ** 2 for i in keep)
            near = np.argsort(np.round(d, 9), kind="stable")
            for k in ks:
                votes = labels[near[:k]]
                out[f, r, k] = out.get((f, r, k), 0) + int((2 * votes.sum() > len(votes)) == actual)
    return out


@pytest.mark.parametrize("repeats", [None, 3])
@pytest.mark.parametrize("rows, queries", [(4096, 64), (7, 4)])
def test_variants_equal_copied_rows(spark, repeats, rows, queries):
    rng = np.random.default_rng(4)
    # a coarse grid of values, so that distances tie and rows repeat
    train = [(int(i), [float(x) for x in rng.integers(0, 3, 4)], int(rng.integers(0, 2))) for i in rng.permutation(40)]
    query = [(100 + i, [float(x) for x in rng.integers(0, 3, 4)], int(rng.integers(0, 2)),
              [float(x) for x in rng.integers(0, 3, 4 * (repeats or 1))]) for i in range(11)]
    t = spark.createDataFrame(train, "vec_id long, vec array<double>, label int")
    q = spark.createDataFrame(query, "vec_id long, vec array<double>, label int, donors array<double>")
    got = variant_accuracy(t, q, [1, 5, 100], repeats, rows=rows, queries=queries).collect()
    assert all(r["n"] == 11 for r in got)
    assert {(r["feature"], r["rep"], r["k"]): r["correct"] for r in got} == brute(train, query, [1, 5, 100], repeats)


def test_smallest_keeps_the_first_of_a_tie():
    d = np.array([[3.0, 1, 1, 1, 0], [1, 1, 1, 1, 1]])
    assert smallest(d, 3).tolist() == [[4, 1, 2], [0, 1, 2]]


def test_donors_are_permutations(spark):
    rows = [(i, [float(i), float(-i)], i % 2) for i in range(50)]
    df = with_donors(spark.createDataFrame(rows, "vec_id long, vec array<double>, label int"), ["a", "b"], repeats=4)
    d = np.array([r["donors"] for r in df.collect()]).reshape(50, 2, 4)
    for r in range(4):
        assert sorted(d[:, 0, r]) == [float(i) for i in range(50)] and sorted(d[:, 1, r]) == sorted(-float(i) for i in range(50))
    assert (d[:, 0, 0] != d[:, 0, 1]).any()


def test_empty_and_bad_rows(spark):
    schema = "vec_id long, vec array<double>, label int"
    none, some = spark.createDataFrame([], schema), spark.createDataFrame([(1, [1.0, 2.0], 1)], schema)
    assert variant_accuracy(none, some, [3]).collect() == [] and variant_accuracy(some, none, [3]).collect() == []
    with pytest.raises(Exception, match="coordinate"):
        variant_accuracy(some, spark.createDataFrame([(1, [1.0, None], 1)], schema), [3]).collect()


def test_few_pairs_get_their_variants_and_none_is_written(spark):
    """On data without clusters most pairs are left out by their bound, and a
    block gives sums only, so nothing grows with pairs but the product itself."""
    import pyarrow as pa

    from tabrisk.operators import variants as V
    rng = np.random.default_rng(1)
    vec = lambda n: pa.array(list(np.clip(rng.normal(0.5, 0.12, (n, 32)), 0, 1)))
    block = V._Block(pa.table({"vec": vec(20), "qid": pa.array(range(20)), "label": pa.array([0] * 20)}), 5, None, "euclidean", V.ROWS)
    seen, pairs = [], block._pairs
    block._pairs = lambda at, t: seen.append(pairs(at, t)) or seen[-1]
    for _ in range(3):
        block.meet(pa.table({"vec": vec(2000), "label": pa.array([1] * 2000)}))
    assert len(seen[-1][0]) < 0.1 * 20 * 2000
    assert len(list(block.count([1, 5], "uniform"))) == 2 * 33


def test_permuted_rows_hand_over_with_two_shuffles_of_the_repeats(spark):
    """Each repeat is ranked and joined once by position, with the receiving
    row already there: nothing is sorted for a join or broadcast."""
    from tabrisk.plans.knn_queries import permuted_rows
    rows = [(i, [float(i), float(-i)], i % 2) for i in range(40)] + [(7, [100.0, -100.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>, label int")
    got = permuted_rows(df, ["a", "b"], repeats=2)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    out = got.where("feature <> 'None'").collect()
    # 39 rows of their own ids and, for the id that comes twice, both rows for both positions
    assert len(out) == 2 * 2 * (39 + 4)
    once = [r for r in out if r["feature"] == "a" and r["rep"] == 1 and r["vec_id"] != 7]
    assert all(r["vec"][1] == -r["vec_id"] for r in once) and len({r["vec"][0] for r in once}) == 39
    assert got.where("feature = 'None'").count() == 41


def _shuffled(spark):
    """Bytes of shuffle files that the session has."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))


def test_training_rows_are_not_written_for_each_block_of_queries(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 16)], i % 2) for i in range(800)]
    t = spark.createDataFrame(rows, "vec_id long, vec array<double>, label int")
    before = _shuffled(spark)
    got = variant_accuracy(t, t, [3], queries=16).collect()                      # 50 blocks
    assert len(got) == 17 and all(r["n"] == 800 for r in got)
    assert _shuffled(spark) - before < 8 * 800 * 16 * 8


def test_only_the_values_of_a_permutation_are_written(spark):
    rng = np.random.default_rng(7)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)], i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, vec array<double>, label int")
    before = _shuffled(spark)
    assert with_donors(df, list("abcd")).where("size(donors) = 120").count() == 600
    assert _shuffled(spark) - before < 2 * 600 * 120 * 8


def test_donors_equal_permuted_rows_and_rows_of_one_id_have_all_of_them(spark):
    from tabrisk.operators import permute
    from tabrisk.plans.knn_queries import permuted_rows
    rows = [(i, [float(i), float(-i)], i % 2) for i in range(2 * permute.PIECE + 5)] + [(7, [9000.0, -9000.0], 1)]
    for some in (rows[:-1], rows):
        df = spark.createDataFrame(some, "vec_id long, vec array<double>, label int")
        want, got = {}, {}
        for r in permuted_rows(df, ["a", "b"], repeats=3).where("feature <> 'None'").collect():
            f = "ab".index(r["feature"])
            want.setdefault((r["vec_id"], f, r["rep"]), set()).add(r["vec"][f])
        for r in with_donors(df, ["a", "b"], repeats=3).collect():
            m = len(r["donors"]) // 6
            for j, d in enumerate(r["donors"]):
                got.setdefault((r["vec_id"], j // (3 * m), j // m % 3), set()).add(d)
        assert {k: v for k, v in got.items() if k[0] != 7} == {k: v for k, v in want.items() if k[0] != 7}
        assert all(len(got[7, f, r]) == len(some) - len(rows) + 2 for f in range(2) for r in range(3))


def test_blocks_in_any_order_keep_ties_by_position():
    import pyarrow as pa

    from tabrisk.operators import variants as V
    rng = np.random.default_rng(9)
    grid = rng.integers(0, 2, (60, 3)).astype(float)
    q = pa.table({"vec": pa.array(list(rng.integers(0, 2, (8, 3)).astype(float))), "qid": pa.array(range(8)), "label": pa.array([0] * 8)})
    labels = pa.array(rng.integers(0, 2, 60).astype(np.int32))
    t = pa.table({"_pos": pa.array(range(1, 61)), "vec": pa.array(list(grid)), "label": labels})
    counts = []
    for order in ([0, 20, 40], [40, 0, 20]):
        block = V._Block(q, 5, None, "euclidean", 7)
        for i in order:
            block.meet(t.slice(i, 20))
        counts.append(list(block.count([1, 5], "uniform")))
    assert counts[0] == counts[1]
