"""Derived inputs shared by the registered queries.

``event_predictions`` is the stored-prediction table (S5 shape: actual,
prediction, probability per row and model) made from ``events``.  The three
"models" are fixed rules over event columns, written once as SQL text so that
Spark (``F.expr``) and the DuckDB oracle evaluate the very same formula.  A
fourth model has no probability, as a fitted model without ``predict_proba``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.sources.tables import table

# name -> (probability SQL or None, prediction SQL)
RULE_MODELS = {
    "ANN": ("least(value / 500, 1.0)", "CASE WHEN least(value / 500, 1.0) >= 0.1 THEN 1 ELSE 0 END"),
    "KNN": ("(user_id % 16) / 15", "CASE WHEN (user_id % 16) / 15 >= 0.5 THEN 1 ELSE 0 END"),
    "SVM": ("least((value + user_id) / 650, 1.0)",
            "CASE WHEN least((value + user_id) / 650, 1.0) >= 0.2 THEN 1 ELSE 0 END"),
    "RULE": (None, "CASE WHEN user_id % 3 = 0 THEN 1 ELSE 0 END"),
}
ACTUAL_SQL = "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"


def event_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long table (row_id, model, actual, prediction, probability): one scan
    of events, one row per (event, model) through ``inline`` -- no union."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    structs = []
    for name, (prob, pred) in RULE_MODELS.items():
        p = F.expr(prob).cast("double") if prob else F.lit(None).cast("double")
        structs.append(F.struct(F.lit(name).alias("model"),
                                F.expr(pred).cast("int").alias("prediction"),
                                p.alias("probability")))
    return ev.select(F.col("event_id").alias("row_id"),
                     F.expr(ACTUAL_SQL).cast("int").alias("actual"),
                     F.inline(F.array(*structs)))


def predictions_sql() -> str:
    """The same table in DuckDB SQL."""
    parts = []
    for name, (prob, pred) in RULE_MODELS.items():
        p = f"CAST({prob} AS DOUBLE)" if prob else "CAST(NULL AS DOUBLE)"
        parts.append(f"SELECT event_id AS row_id, {ACTUAL_SQL} AS actual, '{name}' AS model, "
                     f"CAST({pred} AS INTEGER) AS prediction, {p} AS probability FROM events")
    return "\n UNION ALL ".join(parts)


def event_predictions_folds(spark: SparkSession, sf_dir: str, n_folds: int = 5) -> DataFrame:
    """``event_predictions`` plus a stratified fold per event (E2 with no
    test share): folds are set on the event scan, before the per-model
    rows are made, so no join is needed."""
    from tabrisk.operators.split import split_and_folds
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "value", "event_type")
    ev = ev.withColumn("actual", F.expr(ACTUAL_SQL).cast("int"))
    ev = split_and_folds(ev, "actual", ["event_id"], test_percent=0, n_folds=n_folds)
    structs = []
    for name, (prob, pred) in RULE_MODELS.items():
        p = F.expr(prob).cast("double") if prob else F.lit(None).cast("double")
        structs.append(F.struct(F.lit(name).alias("model"),
                                F.expr(pred).cast("int").alias("prediction"),
                                p.alias("probability")))
    return ev.select(F.col("event_id").alias("row_id"), "actual", "fold", F.inline(F.array(*structs)))


def predictions_folds_sql(n_folds: int = 5) -> str:
    """Folds in SQL: rank inside the class by md5('42-event_id')."""
    return f"""
    SELECT p.*, f.fold FROM ({predictions_sql()}) p JOIN (
      SELECT event_id AS row_id,
             CAST((row_number() OVER (PARTITION BY {ACTUAL_SQL}
                  ORDER BY md5(concat_ws('-', '42', event_id))) - 1) % {n_folds} AS INTEGER) AS fold
      FROM events) f USING (row_id)"""


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prediction history (FIXTURES 1.7 shape) made from events: one row per
    (event, model with a probability): formatted time (F6), model, percent
    probability rounded to 2 places (F3), risk label (P15), the inputs."""
    from tabrisk.contract import HISTORY_TIME_FORMAT
    from tabrisk.functions.expressions import risk_label
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    structs = [F.struct(F.lit(name).alias("model"), F.expr(pred).cast("int").alias("pred"),
                        F.expr(prob).cast("double").alias("prob"))
               for name, (prob, pred) in RULE_MODELS.items() if prob]
    long = ev.select("event_id", "ts", "user_id", "value", F.inline(F.array(*structs)))
    return long.select(F.col("event_id").alias("row_id"),
                       F.date_format("ts", HISTORY_TIME_FORMAT).alias("timestamp"),
                       "model", F.round(F.col("prob") * 100, 2).alias("probability"),
                       risk_label("pred").alias("prediction"), "user_id", "value")


def history_sql() -> str:
    parts = []
    for name, (prob, pred) in RULE_MODELS.items():
        if prob:
            parts.append(
                f"SELECT event_id AS row_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, "
                f"'{name}' AS model, round(CAST({prob} AS DOUBLE) * 100, 2) AS probability, "
                f"CASE WHEN {pred} = 1 THEN 'High Risk' ELSE 'Low Risk' END AS prediction, "
                f"user_id, value FROM events")
    return "\n UNION ALL ".join(parts)
