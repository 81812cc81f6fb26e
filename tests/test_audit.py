"""Provenance audit and duplicates (FIXTURES.md: 20 / 5 / 15 layout)."""

import random

from tabrisk.operators import audit as AU


def _layout(spark, kind):
    rnd = random.Random(1)
    orig = [(float(i), float(rnd.randint(0, 9)), i % 2) for i in range(20)]
    dup = [orig[rnd.randrange(20)] for _ in range(5)]
    rest = [(100.0 + i, 1.0, 0) for i in range(15)]
    if kind == "dup_in_original":
        orig[5] = orig[4]
    if kind == "stranger":
        dup[2] = (999.0, 9.0, 1)
    if kind == "null_in_copy":
        dup[0] = (None, orig[0][1], orig[0][2])
    rows = orig + dup + rest
    if kind == "wrong_count":
        rows = rows[:-1]
    data = [(i + 1, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "position long, a double, b double, y int")


def _audit(spark, kind):
    df = _layout(spark, kind)
    rep = AU.provenance_audit(df, "position", ["a", "b", "y"], 20, 25, 40)
    return {r["rule"]: r["passed"] for r in rep.collect()}


def test_good_layout_passes(spark):
    assert _audit(spark, "good") == {"row_count": 1, "original_unique": 1, "duplicate_block_in_original": 1}


def test_failures(spark):
    assert _audit(spark, "wrong_count")["row_count"] == 0
    assert _audit(spark, "dup_in_original")["original_unique"] == 0
    assert _audit(spark, "stranger")["duplicate_block_in_original"] == 0
    assert _audit(spark, "null_in_copy")["duplicate_block_in_original"] == 0


def test_repeat_rows_count_null_equal_null(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,)], "v string")
    assert AU.duplicate_stats(df, ["v"]).first()["n_repeats"] == 2


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "x", 1.0), (1, "x", 2.0), (2, "y", 3.0)], "k long, g string, v double")
    got = {r["g"]: (r["k"], r["v"], r["copies"]) for r in AU.keep_first(df, ["g"], "k").collect()}
    assert got == {"x": (1, 2.0, 2), "y": (2, 3.0, 1)}
