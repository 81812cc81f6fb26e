"""E3 preprocessing and the exact median at scale."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrisk.operators.prep import RiskPreprocessor, RiskPreprocessorModel
from tabrisk.operators.quantiles import exact_medians


def test_even_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    assert exact_medians(df, ["x"])["x"] == 2.5


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_median_refinement_matches_numpy(spark, seed):
    rnd = np.random.default_rng(seed)
    vals = np.concatenate([rnd.lognormal(0, 3, 3001), np.full(1500, 7.25)])   # a hot value
    rnd.shuffle(vals)
    df = spark.createDataFrame([(float(v), float(v) * 2 if i % 3 else None) for i, v in enumerate(vals)],
                               "a double, b double")
    # tiny final size forces several histogram passes
    got = exact_medians(df, ["a", "b"], n_bins=16, final_rows=8)
    assert got["a"] == float(np.median(vals))
    bvals = [float(v) * 2 for i, v in enumerate(vals) if i % 3]
    assert got["b"] == float(np.median(bvals))


def test_fit_transform_zero_missing_constant_and_clip(spark):
    train = spark.createDataFrame([(0.0, 5.0, 1.0), (2.0, 5.0, 2.0), (4.0, 5.0, 3.0), (6.0, 5.0, 4.0)],
                                  "g double, c double, x double")
    m = RiskPreprocessor(inputCols=["g", "c", "x"], zeroMissingCols=["g"]).fit(train)
    med, lo, hi = m.stats()["g"]
    assert (med, lo, hi) == (4.0, 2.0, 6.0)                # the zero is missing
    test = spark.createDataFrame([(0.0, 5.0, 0.0), (None, 9.0, 10.0)], "g double, c double, x double")
    rows = m.transform(test).collect()
    assert rows[0]["g"] == 0.5 and rows[1]["g"] == 0.5      # zero and null -> median 4 -> 0.5
    assert rows[0]["c"] == 0.0 and rows[1]["c"] == 1.0      # constant column: range 1, then clip
    assert rows[0]["x"] == 0.0 and rows[1]["x"] == 1.0      # clipped to [0, 1]


def test_transform_adds_no_exchange(spark):
    train = spark.createDataFrame([(float(i), float(i % 7)) for i in range(50)], "a double, b double")
    m = RiskPreprocessor(inputCols=["a", "b"]).fit(train)
    plan = m.transform(train)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_save_load_round_trip(spark, tmp_dir):
    train = spark.createDataFrame([(float(i),) for i in range(9)], "a double")
    m = RiskPreprocessor(inputCols=["a"]).fit(train)
    m.write().overwrite().save(tmp_dir + "/prep")
    m2 = RiskPreprocessorModel.load(tmp_dir + "/prep")
    assert m2.stats() == m.stats()


def test_nan_is_missing_and_infinity_is_an_error(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, float("nan"), 4.0)], "x double")
    for zero in ([], ["x"]):
        model = RiskPreprocessor(inputCols=["x"], zeroMissingCols=zero).fit(df)
        assert model.stats()["x"] == (2.0, 1.0, 4.0)
        assert sorted(r["x"] for r in model.transform(df).collect()) == [0.0, 1 / 3, 1 / 3, 1.0]
    with pytest.raises(ValueError, match="infinite"):
        RiskPreprocessor(inputCols=["x"], zeroMissingCols=[]).fit(df.union(spark.createDataFrame([(float("inf"),)], "x double")))
