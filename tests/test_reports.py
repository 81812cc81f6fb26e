"""Batches that count once, merged reports, CSV by name, the reduced ROC curve."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabrisk.contract import ColumnRule, TableContract
from tabrisk.functions.expressions import number_text, title_case
from tabrisk.operators import metrics as M
from tabrisk.sources import files, history
from tabrisk.sources.reports import find_reports, merge_reports

ROW = "timestamp string, model string, probability double, prediction string, f1 double"


def rows(spark, *values):
    return spark.createDataFrame([("2024-01-01 00:00:00", "SVM" if v % 2 else "ANN", 1.0, "Low Risk", float(v)) for v in values], ROW)


def test_batch_counts_once(spark, tmp_dir):
    path = os.path.join(tmp_dir, "history")
    history.clear_history(spark, path, ["f1"])
    assert history.append_history(rows(spark, 1, 2), path, "a")
    assert not history.append_history(rows(spark, 1, 2), path, "a")
    assert history.append_history(rows(spark, 3), path, "b")
    history.append_history(rows(spark, 4), path)                      # without an id: as before
    h = history.load_history(spark, path, ["f1"])
    assert sorted(r["f1"] for r in h.collect()) == [1.0, 2.0, 3.0, 4.0]
    assert h.columns == [*history.HISTORY_COLUMNS, "f1"]
    history.clear_history(spark, path, ["f1"])
    assert history.load_history(spark, path, ["f1"]).count() == 0
    assert history.append_history(rows(spark, 1), path, "a")          # cleared batches may come again


def test_two_runs_of_one_batch_and_one_that_broke_off(spark, tmp_dir):
    path = os.path.join(tmp_dir, "history")
    history.append_history(rows(spark, 1, 2), path, "a")
    # a second run that saw no commit writes and commits too; a third writes and dies before its commit
    for folder, commit in (("zz", True), ("yy", False)):
        rows(spark, 1, 2).withColumn("folder", F.lit(folder)).write.mode("append").partitionBy("folder", "model").parquet(f"{path}/_history/batches")
        if commit:
            spark.createDataFrame([("a", folder, 1 << 60)], history.COMMITS).write.mode("append").parquet(f"{path}/_history/commits")
    assert sorted(r["f1"] for r in history.load_history(spark, path, ["f1"]).collect()) == [1.0, 2.0]


def test_missing_reports_and_keys(spark, tmp_dir):
    schema = "removed string, accuracy double"
    spark.createDataFrame([("None", 0.9), ("a", 0.8), (None, 0.1)], schema).write.parquet(f"{tmp_dir}/ann")
    spark.createDataFrame([("b", 0.7), ("None", 0.6), (None, 0.2)], schema).write.parquet(f"{tmp_dir}/SVM")
    found, missing = find_reports(spark, tmp_dir)
    assert missing == ["KNN"]
    got = {r["removed"]: tuple(r)[1:] for r in merge_reports(found, "removed", ["accuracy"]).collect()}
    assert got == {"None": (0.9, None, 0.6), "a": (0.8, None, None), "b": (None, None, 0.7), None: (0.1, None, 0.2)}
    none, every = find_reports(spark, os.path.join(tmp_dir, "nowhere"))
    assert none == {} and every == ["ANN", "KNN", "SVM"]
    assert merge_reports({}, "removed", ["accuracy"]).collect() == []
    twice = spark.createDataFrame([("a", 0.1), ("a", 0.2)], schema)
    with pytest.raises(ValueError, match="repeated"):
        merge_reports({"ANN": twice}, "removed", ["accuracy"])


def test_csv_by_name(spark, tmp_dir):
    def write(name, text):
        folder = os.path.join(tmp_dir, name)
        os.makedirs(folder, exist_ok=True)
        with open(os.path.join(folder, name + ".csv"), "w") as f:
            f.write(text)
        return folder
    a, b = write("a", "x,y\n1,10\n3,NA\n"), write("b", "y,extra,x\n20,z,2\n")
    got = files.read_csv_by_name(spark, [a, b])
    assert sorted(got.select("x", "y").collect()) == [("1", "10"), ("2", "20"), ("3", None)]
    assert sorted(files.read_csv_by_name(spark, [a, b], ["y"]).collect(), key=str) == sorted([("10",), ("20",), (None,)], key=str)
    with pytest.raises(ValueError, match="no column y"):
        files.read_csv_by_name(spark, [a, write("c", "x,z\n1,1\n")], ["x", "y"])
    contract = TableContract((ColumnRule("x", 0, 10),), target="y", target_values=(10, 20))
    with pytest.raises(ValueError, match="y: 1"):
        files.load_dataset(spark, [a, b], contract, any_order=True)


@pytest.mark.parametrize("n_buckets", [1, 3, 64])
def test_roc_without_collinear_points(spark, n_buckets):
    rng = np.random.default_rng(n_buckets)
    data = [("A", int(y), float(s)) for y, s in zip(rng.integers(0, 2, 120), rng.integers(0, 60, 120))] + [("B", 1, 0.5), ("B", 0, 0.2), ("C", 1, 0.1)]
    df = spark.createDataFrame(data, "model string, actual int, probability double")
    st = M.score_table(df, n_buckets=n_buckets, neighbours=True).collect()
    for model in "ABC":
        own = sorted((r for r in st if r["model"] == model), key=lambda r: -r["probability"])
        assert [(r["pos_next"], r["neg_next"]) for r in own] == [(r["pos"], r["neg"]) for r in own[1:]] + [(None, None)]
    got = {(r["model"], r["threshold"]) for r in M.roc_points(df, drop_collinear=True).collect()}
    want = set()
    for model in "ABC":
        own = [(s, y) for m, y, s in data if m == model]
        scores = sorted({s for s, _ in own}, reverse=True)
        fps, tps = (np.cumsum([sum(t == s and y == c for t, y in own) for s in scores]) for c in (0, 1))
        keep = np.ones(len(scores), bool)
        if len(scores) > 2:
            keep[1:-1] = (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0)
        want |= {(model, float("inf"))} | {(model, s) for s, k in zip(scores, keep) if k}
    assert got == want


def test_texts(spark):
    df = spark.createDataFrame([(0.12345678, "aNN model"), (None, None), (-2.0, "x")], "v double, s string")
    got = df.select(number_text("v"), number_text("v", signed=True), number_text("v", 1), title_case("s")).collect()
    assert [tuple(r) for r in got] == [("0.1235", "+0.1235", "0.1", "Ann Model"), (None, None, None, None), ("-2.0000", "-2.0000", "-2.0", "X")]


def test_rule_importance_shuffles_some_repeats_at_a_time(spark, tmp_dir, monkeypatch):
    """Repeats are ranked and joined in parts, the files of one gone before the
    next; the rows do not depend on the parts."""
    from tabrisk.plans import queries as Q
    rows = [(i, i * 7 % 50, f"{'purchase' if i % 3 else 'view'}", i * 13 % 40 / 1.0) for i in range(3000)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_dir}/events.parquet")

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(i).length() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_"))

    whole = Q.importance_rules(spark, tmp_dir).collect()
    monkeypatch.setattr(Q, "PERMUTED_ROWS", 7 * 6000)
    before = files()
    parts = Q.importance_rules(spark, tmp_dir).collect()
    assert sorted(parts) == sorted(whole) and len(whole) == 2
    # 60 x 3000 rows were shuffled twice
    assert files() - before < 60 * 3000 * 4
