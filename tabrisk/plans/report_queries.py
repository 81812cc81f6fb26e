"""Reports that are written, found and merged, files in any column order, the
reduced ROC curve, and the texts of a report; with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabrisk.contract import EVENT_BATCH, LINEITEM, MODEL_NAMES
from tabrisk.functions.expressions import number_text, title_case
from tabrisk.operators import metrics as M
from tabrisk.operators import validate as V
from tabrisk.operators.threshold import best_threshold, threshold_curve
from tabrisk.plans.datasets import event_predictions, event_predictions_folds
from tabrisk.plans.oracle import CLASSIFICATION_METRICS, PRED, SCORES, THRESHOLD_TUNING
from tabrisk.session import checkpoint_dir
from tabrisk.sources.files import export_csv, load_dataset, read_csv_by_name, write_table
from tabrisk.sources.history import models_in_history
from tabrisk.sources.reports import find_reports, merge_reports
from tabrisk.sources.tables import lineitem_patients, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def roc_points_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ROC curve without points that lie on a line between their
    neighbours at equal steps, as it is drawn."""
    return M.roc_points(event_predictions(spark, sf_dir), drop_collinear=True)


def reports_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy reports by event type, each written by its model,
    found below one folder and merged by a full outer join.  The ANN's report
    lacks the first type, the KNN's the last, the SVM left none."""
    pred = event_predictions(spark, sf_dir).join(
        table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), "event_type"), "row_id")
    right = F.avg((F.col("prediction") == F.col("actual")).cast("double"))
    by_type = pred.where(F.col("model").isin("ANN", "KNN")).groupBy("model", "event_type").agg(right.alias("accuracy"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("model")                          # one row per model and event type
    by_type = by_type.withColumn("change", F.col("accuracy") - F.sum(F.col("accuracy") * F.col("n")).over(whole) / F.sum("n").over(whole))
    first, last = F.min("event_type").over(whole), F.max("event_type").over(whole)
    left = F.when(F.col("model") == "ANN", F.col("event_type") > first).otherwise(F.col("event_type") < last)
    kept = by_type.withColumn("_left", left).where("_left").select("model", "event_type", F.round("accuracy", 9).alias("accuracy"), F.round("change", 9).alias("change"))
    root = _folder(spark, "reports")
    for name in ("ANN", "KNN"):
        write_table(kept.where(F.col("model") == name).drop("model"), f"{root}/{name}")
    found, missing = find_reports(spark, root)
    return merge_reports(found, "event_type", ["accuracy", "change"]).withColumn("missing_reports", F.lit(", ".join(missing)))


def csv_any_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as CSV files of two column orders, one with a column
    more, read back by name."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
    root = _folder(spark, "csv")
    odd = F.col("p_partkey") % 2 == 1
    export_csv(part.where(odd), f"{root}/a")
    export_csv(part.where(~odd).select("p_retailprice", "p_partkey", F.lit("x").alias("note"), "p_size", "p_name"), f"{root}/b")
    rows = read_csv_by_name(spark, [f"{root}/a", f"{root}/b"], part.columns)
    return rows.select(F.col("p_partkey").cast("long").alias("p_partkey"), "p_name", F.col("p_size").cast("int").alias("p_size"),
                       F.col("p_retailprice").cast("double").alias("p_retailprice"))


def report_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics rows, written and read back, as texts: names
    in small letters and as titles, numbers with four places and a sign, the
    models there are, and the batch's columns that the contract doesn't know."""
    pred = event_predictions(spark, sf_dir)
    path = _folder(spark, "metrics")
    write_table(M.classification_metrics(M.confusion_counts(pred)).select("model", "accuracy"), path, partition_by=["model"])
    rows = spark.read.parquet(path)
    names = ", ".join(r["model"] for r in models_in_history(rows).collect())                 # one row per model
    extra = ", ".join(V.check_schema(table(spark, sf_dir, "events").columns, EVENT_BATCH))
    change = F.col("accuracy") - F.max("accuracy").over(Window.partitionBy())                # one row per model
    return rows.withColumn("change", change).select(
        F.lower("model").alias("model_key"), title_case("model").alias("model_title"), number_text("accuracy").alias("accuracy"),
        number_text("change", signed=True).alias("change"), F.lit(names).alias("models"), F.lit(extra).alias("extra_columns"))


def metrics_stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One metrics row a model from its own stored
    predictions, those of the SVM with its tuned threshold, stacked by name."""
    pred = event_predictions(spark, sf_dir)
    path = _folder(spark, "predictions")
    write_table(pred, path, partition_by=["model"])                                          # S5
    stored = spark.read.parquet(path)
    best = best_threshold(threshold_curve(event_predictions_folds(spark, sf_dir).where("model = 'SVM'")))
    tuned = best.select("model", F.round("threshold", 9).alias("best_threshold"), F.round("cv_accuracy_mean", 9).alias("cv_accuracy_mean"))
    frames = []
    for name in MODEL_NAMES:
        rows = M.classification_metrics(M.confusion_counts(stored.where(F.col("model") == name)))
        frames.append(rows.join(tuned, "model") if name == "SVM" else rows)
    return M.union_metric_rows(frames)


def training_table_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training table as uploaded CSV files of two
    column orders, loaded, checked and typed by its contract."""
    rows = lineitem_patients(spark, sf_dir).select(*LINEITEM.feature_names, "label")
    root = _folder(spark, "training")
    part = F.pmod(F.xxhash64(*rows.columns), F.lit(2))
    export_csv(rows.where(part == 0), f"{root}/a")
    export_csv(rows.where(part == 1).select(*reversed(rows.columns)), f"{root}/b")
    loaded = load_dataset(spark, [f"{root}/a", f"{root}/b"], LINEITEM, any_order=True)
    return loaded.groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"), *[F.round(F.avg(c), 6).alias(f"avg_{c}") for c in LINEITEM.feature_names])


REPORT_QUERIES = {
    "metrics_stacked": metrics_stacked,
    "training_table_loaded": training_table_loaded,
    "roc_points_reduced": roc_points_reduced,
    "reports_merged": reports_merged,
    "csv_any_order": csv_any_order,
    "report_texts": report_texts,
}

_EXTRA = ", ".join(c for c in ("event_id", "ts", "user_id", "event_type", "value", "props")
                   if c not in (*EVENT_BATCH.feature_names, EVENT_BATCH.row_id))

REPORT_ORACLE = {
    "roc_points_reduced": f"""WITH {SCORES},
n AS (SELECT *, lead(pos) OVER w AS pos_next, lead(neg) OVER w AS neg_next, row_number() OVER w AS r
      FROM st WINDOW w AS (PARTITION BY model ORDER BY probability DESC))
SELECT model, probability AS threshold, round(CASE WHEN N > 0 THEN neg_cum / N END, 9) AS fpr,
       round(CASE WHEN P > 0 THEN pos_cum / P END, 9) AS tpr FROM n
WHERE r = 1 OR pos_next IS NULL OR pos_next <> pos OR neg_next <> neg
UNION ALL
SELECT DISTINCT model, CAST('inf' AS DOUBLE), 0.0, 0.0 FROM st""",
    "reports_merged": f"""WITH {PRED},
t AS (SELECT model, event_type, avg(CASE WHEN prediction = actual THEN 1.0 ELSE 0.0 END) AS accuracy, count(*) AS n
      FROM pred JOIN events ON event_id = row_id GROUP BY model, event_type),
c AS (SELECT model, event_type, round(accuracy, 9) AS accuracy,
             round(accuracy - sum(accuracy * n) OVER (PARTITION BY model) / sum(n) OVER (PARTITION BY model), 9) AS change FROM t),
a AS (SELECT event_type, accuracy, change FROM c WHERE model = 'ANN' AND event_type > (SELECT min(event_type) FROM events)),
k AS (SELECT event_type, accuracy, change FROM c WHERE model = 'KNN' AND event_type < (SELECT max(event_type) FROM events))
SELECT coalesce(a.event_type, k.event_type) AS event_type, a.accuracy AS ann_accuracy, a.change AS ann_change,
       k.accuracy AS knn_accuracy, k.change AS knn_change, CAST(NULL AS DOUBLE) AS svm_accuracy, CAST(NULL AS DOUBLE) AS svm_change,
       'SVM' AS missing_reports FROM a FULL OUTER JOIN k ON a.event_type = k.event_type""",
    "metrics_stacked": f"""SELECT c.model, support, accuracy, precision, recall, f1, best_threshold, cv_accuracy_mean
FROM ({CLASSIFICATION_METRICS}) c LEFT JOIN ({THRESHOLD_TUNING}) t ON t.model = c.model AND c.model = 'SVM'
WHERE c.model IN ('ANN', 'KNN', 'SVM')""",
    "training_table_loaded": "SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, count(*) AS n_rows, "
                             + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in LINEITEM.feature_names) + " FROM lineitem GROUP BY ALL",
    "csv_any_order": "SELECT p_partkey, p_name, p_size, p_retailprice FROM part",
    "report_texts": f"""WITH m AS ({CLASSIFICATION_METRICS})
SELECT lower(model) AS model_key, upper(substr(model, 1, 1)) || lower(substr(model, 2)) AS model_title,
       printf('%.4f', accuracy) AS accuracy, printf('%+.4f', accuracy - max(accuracy) OVER ()) AS change,
       (SELECT string_agg(model, ', ' ORDER BY model) FROM m) AS models, '{_EXTRA}' AS extra_columns FROM m""",
}
