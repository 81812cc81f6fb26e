"""Plan checks: pruned scans, pushed filters, no cross joins."""

import __spark_entry__ as E

from .conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_needed_columns(spark):
    plan = _plan(E.queries()["contract_violations"](spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int,c_acctbal:double>" in plan or \
           "ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_nationkey:int>" in plan
    assert "c_name" not in plan


def test_history_filter_pushed_to_scan(spark, tmp_dir):
    from pyspark.sql import functions as F
    from tabrisk.sources import history
    path = f"{tmp_dir}/history"
    scored = spark.createDataFrame([(1.0, 1, 0.7)], "f1 double, p int, prob double")
    for model in ("SVM", "KNN"):
        history.append_history(history.history_rows(scored, model, ["f1"], "p", "prob"), path)
    read = history.load_history(spark, path, ["f1"]).where((F.col("model") == "SVM") & (F.col("probability") > 1)).select("probability")
    plan = _plan(read)
    assert "GreaterThan(probability,1.0)" in plan and "PartitionFilters: [isnotnull(model" in plan
    assert "f1" not in plan.split("ReadSchema:")[1].splitlines()[0]


def test_no_cartesian_product_in_sql_checked_queries(spark):
    for name in ("knn_predict", "knn_ablation", "roc_auc", "stratified_folds", "provenance_audit"):
        plan = _plan(E.queries()[name](spark, SF_SMALL))
        assert "CartesianProduct" not in plan, name
