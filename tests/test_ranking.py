"""Bucketed ranks, running sums and salted bottom-k equal their one-task forms."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabrisk.operators.ranking import (bottom_k, bucketed_row_number, bucketed_running_sum,
                                       position_by_key, quantile_bucket)


def _df(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("abc"), rnd.random()) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, g string, v double")


def test_bucketed_row_number(spark):
    df = _df(spark).withColumn("b", F.floor(F.col("v") * 37))
    got = bucketed_row_number(df, ["g"], "b", ["v", "id"], out="r")
    ref = df.withColumn("r2", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    j = got.join(ref, "id")
    assert j.where(F.col("r") != F.col("r2")).count() == 0


def test_running_sum_over_quantile_buckets(spark):
    df = _df(spark).withColumn("w", F.lit(1))
    qb = quantile_bucket(df, ["g"], "v", n_buckets=16)
    got = bucketed_running_sum(qb, ["g"], "_qb", ["v"], ["w"])
    ref = df.withColumn("c", F.sum("w").over(Window.partitionBy("g").orderBy("v")
                                               .rowsBetween(Window.unboundedPreceding, 0)))
    j = got.select("id", "w_cum").join(ref.select("id", "c"), "id")
    assert j.where(F.col("w_cum") != F.col("c")).count() == 0


def test_bottom_k(spark):
    df = _df(spark)
    got = bottom_k(df, ["g"], ["v", "id"], 7, salt_by=["id"], salts=5)
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id"))).where("r <= 7")
    assert sorted((r["g"], r["id"], r["rank"]) for r in got.collect()) == \
        sorted((r["g"], r["id"], r["r"]) for r in ref.collect())


def test_position_by_key(spark):
    df = spark.createDataFrame([(k,) for k in random.Random(5).sample(range(10**6), 500)], "k long")
    got = sorted((r["k"], r["position"]) for r in position_by_key(df, "k", target_buckets=13).collect())
    assert [p for _, p in got] == list(range(1, 501))


def test_position_refuses_null_keys(spark):
    import pytest
    from tabrisk.operators.ranking import position_by_key
    with pytest.raises(ValueError, match="1 rows have no key"):
        position_by_key(spark.createDataFrame([(1,), (None,)], "k long"), "k")


def test_positions_of_skewed_keys_and_texts(spark):
    """A third of the rows share one key and one key lies far off: no partition
    holds over twice the mean; texts sort by code point; ties follow each other."""
    from tabrisk.operators.ranking import placed
    rng = random.Random(6)
    keys = [7] * 20_000 + [10 ** 18] + [rng.randrange(50) for _ in range(20_000)] + list(range(10 ** 6, 10 ** 6 + 20_000))
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i long")
    rows, offsets = placed(df, ["k"], 16)
    sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
    assert sum(sizes) == len(keys) and max(sizes) <= 2 * len(keys) / 16
    got = position_by_key(df, "k", target_buckets=16).collect()
    assert sorted(r["position"] for r in got) == list(range(1, len(keys) + 1))
    by_place = sorted(got, key=lambda r: r["position"])
    assert [r["k"] for r in by_place] == sorted(keys)
    words = ["é", "z", "a", "Z", "aa", "", "ß", "a b"]
    texts = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r["w"]: r["position"] for r in position_by_key(texts, "w").collect()}
    assert sorted(words, key=lambda w: w.encode()) == sorted(got, key=got.get)
    assert position_by_key(texts.limit(0), "w").collect() == []
