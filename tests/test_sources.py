"""Sources and sinks: CSV text scan, row numbers, history, registry."""

import os

import pytest

from pyspark.sql import functions as F

from tabrisk.contract import ColumnRule, TableContract
from tabrisk.sources import files, history, registry


def test_csv_text_na_words_and_row_numbers(spark, tmp_dir):
    d = os.path.join(tmp_dir, "batch")
    os.makedirs(d)
    with open(os.path.join(d, "a.csv"), "w") as f:
        f.write("x,y\n1,NA\n2,null\n3, NA\n")
    with open(os.path.join(d, "b.csv"), "w") as f:
        f.write("x,y\n" + "".join(f"{i},v{i}\n" for i in range(10, 15)))
    df = files.with_row_numbers(files.read_csv_text(spark, d))
    rows = {(os.path.basename(r["source_file"]), r["csv_row"]): (r["x"], r["y"]) for r in df.collect()}
    assert rows[("a.csv", 1)] == ("1", None) and rows[("a.csv", 2)] == ("2", None)
    assert rows[("a.csv", 3)] == ("3", " NA")        # not an exact NA word
    assert rows[("b.csv", 5)] == ("14", "v14")
    assert len(rows) == 8


def test_history_append_read_clear(spark, tmp_dir):
    path = os.path.join(tmp_dir, "history")
    feats = ["f1", "f2"]
    empty = history.load_history(spark, path, feats)
    assert empty.count() == 0 and empty.columns[:4] == history.HISTORY_COLUMNS
    scored = spark.createDataFrame([(1.0, 2.0, 1, 0.734567), (3.0, 4.0, 0, 0.1)],
                                   "f1 double, f2 double, p int, prob double")
    history.append_history(history.history_rows(scored, "SVM", feats, "p", "prob"), path)
    history.append_history(history.history_rows(scored, "KNN", feats, "p", None), path)
    h = history.load_history(spark, path, feats)
    assert h.count() == 4
    assert {r["probability"] for r in h.where("model = 'SVM'").collect()} == {73.46, 10.0}
    assert [r["model"] for r in history.models_in_history(h).collect()] == ["KNN", "SVM"]
    c = {(r["model"], r["prediction"]): r["n"] for r in history.history_counts(h, ["SVM"]).collect()}
    assert c == {("SVM", "High Risk"): 1, ("SVM", "Low Risk"): 1}
    assert history.newest_first(h, 1).count() == 2
    history.clear_history(spark, path, feats)
    assert history.load_history(spark, path, feats).count() == 0


def test_registry_signature_and_hashes(spark, tmp_dir):
    for m in ("svm", "ann"):
        os.makedirs(os.path.join(tmp_dir, m))
        with open(os.path.join(tmp_dir, m, "part"), "w") as f:
            f.write(m * 10)
    reg = registry.model_registry(spark, tmp_dir)
    assert sorted(r["model"] for r in reg.collect()) == ["ANN", "SVM"]
    assert [r["model"] for r in registry.missing_models(reg).collect()] == ["KNN"]
    sig = registry.artifact_signature(spark, [os.path.join(tmp_dir, "svm")]).collect()
    assert sig[0]["length"] == 30
    h = registry.content_hashes(spark, os.path.join(tmp_dir, "ann")).first()
    import hashlib
    assert h["sha256"] == hashlib.sha256(b"ann" * 10).hexdigest()


def test_sinks_round_trip(spark, tmp_dir):
    df = spark.createDataFrame([("SVM", 0.7), ("KNN", 0.8)], "model string, accuracy double")
    files.write_table(df, tmp_dir + "/metrics", partition_by=["model"])
    back = spark.read.parquet(tmp_dir + "/metrics").where(F.col("model") == "KNN")
    assert back.first()["accuracy"] == 0.8
    files.export_csv(df, tmp_dir + "/csv")
    assert spark.read.option("header", True).csv(tmp_dir + "/csv").count() == 2


def _write(folder, **csv):
    os.makedirs(folder, exist_ok=True)
    for name, text in csv.items():
        with open(os.path.join(folder, name + ".csv"), "w") as f:
            f.write(text)
    return folder


def test_csv_quotes_and_newlines(spark, tmp_dir):
    d = _write(os.path.join(tmp_dir, "q"), a='x,y\n1,"a ""q"" b"\n2,"two\nlines"\n3,plain\n')
    got = {r["x"]: r["y"] for r in files.read_csv_text(spark, d, multi_line=True).collect()}
    assert got == {"1": 'a "q" b', "2": "two\nlines", "3": "plain"}


def test_csv_headers_of_another_order_are_an_error(spark, tmp_dir):
    d = _write(os.path.join(tmp_dir, "h"), a="x,y\n1,10\n", b="y,x\n20,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        files.read_csv_text(spark, d).collect()
    one = _write(os.path.join(tmp_dir, "one"), a="y,x\n20,2\n")
    assert files.read_csv_text(spark, one).select("x", "y").collect() == [("2", "20")]


def test_load_dataset(spark, tmp_dir):
    contract = TableContract((ColumnRule("f1", 0, 10), ColumnRule("f2", 0, 10)), target="y")
    good = _write(os.path.join(tmp_dir, "g"), a="y,f2,extra,f1\n1,2.5,z,NA\n0,,z,3\n")
    df = files.load_dataset(spark, good, contract)
    assert df.dtypes == [("f1", "double"), ("f2", "double"), ("y", "int")]
    assert sorted(df.collect(), key=str) == sorted([(None, 2.5, 1), (3.0, None, 0)], key=str)
    for text, said in (("f1,y\n1,1\n", "f2"), ("f1,f2,y\nabc,1,1\n2,1,0\n", "f1: 1"), ("f1,f2,y\n,1,1\n", "f1: empty"),
                       ("f1,f2,y\n1,1,2\n1,1,\n", "y: 2")):
        bad = _write(os.path.join(tmp_dir, said.replace(" ", "").replace(":", "")), a=text)
        with pytest.raises(ValueError, match=said):
            files.load_dataset(spark, bad, contract)


def test_history_ties_and_clear_under_dynamic_overwrite(spark, tmp_dir):
    path = os.path.join(tmp_dir, "history")
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "SVM", p, "Low Risk", float(i)) for i, p in enumerate([3.0, 1.0, None, 2.0])],
                                 "timestamp string, model string, probability double, prediction string, f1 double")
    history.append_history(rows, path)
    h = history.load_history(spark, path, ["f1"])
    assert [r["probability"] for r in history.newest_first(h).collect()] == [None, 1.0, 2.0, 3.0]
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        history.clear_history(spark, path, ["f1"])
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    assert history.load_history(spark, path, ["f1"]).count() == 0


def test_headers_need_no_sort_of_the_lines(spark, tmp_dir):
    """A file's first line is found by its number; a text in the aggregate would sort every line."""
    import os

    from tabrisk.sources.files import csv_headers
    for name, lines in (("a", "x,y\n1,2\n0,0\n"), ("b", "y,x\n2,1\n"), ("c", "")):
        with open(os.path.join(tmp_dir, f"{name}.csv"), "w") as f:
            f.write(lines)
    got = csv_headers(spark, tmp_dir)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "min_by" not in plan
    assert sorted(r["header"] for r in got.collect()) == ["x,y", "y,x"]
