"""Largest-remainder quotas, cut-bucket split = full-rank split."""

from pyspark.sql import functions as F

from tabrisk.operators.split import class_quotas, split_and_folds, stratified_split


def test_quotas_for_768_rows(spark):
    counts = spark.createDataFrame([(0, 500), (1, 268)], "label int, n_class long")
    q = {r["label"]: r["quota"] for r in class_quotas(counts, "label").collect()}
    assert q == {0: 100, 1: 54}                      # 154 test rows, as published


def test_split_matches_folds_and_brute_force(spark):
    import hashlib
    rows = [(i, i % 3 if i % 10 else 1) for i in range(2000)]
    df = spark.createDataFrame(rows, "k long, y int")
    a = {r["k"]: r["split"] for r in stratified_split(df, "y", ["k"]).collect()}
    bf = split_and_folds(df, "y", ["k"]).collect()
    b = {r["k"]: r["split"] for r in bf}
    assert a == b
    # brute force: per class, first quota rows in md5 order are test
    by = {}
    for k, y in rows:
        by.setdefault(y, []).append((hashlib.md5(f"42-{k}".encode()).hexdigest(), k))
    q = {r["y"]: r["quota"] for r in class_quotas(
        spark.createDataFrame([(y, len(v)) for y, v in by.items()], "y int, n_class long"), "y").collect()}
    for y, v in by.items():
        test = {k for _, k in sorted(v)[:q[y]]}
        assert {k for k, s in a.items() if s == "test" and dict(rows)[k] == y} == test
    # folds: train rows only, 5 folds of near-equal size per class
    sizes = {}
    for r in bf:
        if r["split"] == "train":
            sizes[(r["y"], r["fold"])] = sizes.get((r["y"], r["fold"]), 0) + 1
        else:
            assert r["fold"] is None
    for y in by:
        s = [sizes[(y, f)] for f in range(5)]
        assert max(s) - min(s) <= 1


def test_null_labels_are_an_error(spark):
    import pytest
    from tabrisk.operators.split import split_and_folds, stratified_split
    df = spark.createDataFrame([(i, None if i % 4 == 0 else i % 2) for i in range(20)], "id long, y int")
    for split in (stratified_split, split_and_folds):
        with pytest.raises(ValueError, match="5 rows have no label"):
            split(df, "y", ["id"])


def test_split_equals_one_window_with_ties_and_small_buckets(spark):
    """Against one row_number per class: repeated rows on both sides of the
    quota, nulls in the tie-break, and buckets that are counted by more digits."""
    import random
    from pyspark.sql import Window
    from tabrisk.functions.expressions import hash_key
    rng = random.Random(2)
    rows = [(rng.randrange(40), rng.choice("abc"), rng.choice([None, 1.0, 2.0])) for _ in range(600)] + [(i, "a", 0.5) for i in range(1000, 1400)]
    df = spark.createDataFrame(rows, "k long, y string, t double")
    for per in (1 << 20, 3):
        got = stratified_split(df, "y", ["k"], tiebreak=["t"], rows_per_bucket=per)
        assert got.columns == ["k", "y", "t", "split"]
        counts = {r["y"]: r["n"] for r in df.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
        from tabrisk.operators.split import quota_table
        quota = quota_table(counts)
        ranked = df.withColumn("_h", hash_key(42, "k")).withColumn("r", F.row_number().over(Window.partitionBy("y").orderBy("_h", "t"))).collect()
        want = sorted(((r["k"], r["y"], r["t"], "test" if r["r"] <= quota[r["y"]] else "train") for r in ranked), key=str)
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_split_of_unique_rows_scans_once(spark):
    """No union, no window and no join in the split's own plan."""
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("y"))
    plan = stratified_split(df, "y", ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Window" not in plan and "Join" not in plan
    assert stratified_split(df.limit(0), "y", ["id"]).count() == 0
