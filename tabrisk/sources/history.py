"""The append-only prediction history.

The history is a Parquet table partitioned by model.  Appending writes new
files only (the reference rewrote the whole file per prediction), reading a
missing or empty history gives an empty frame with the fixed schema, and
clearing overwrites it with an empty frame of the same schema.

A batch that is appended under an id counts once, however often or by how many
runs at a time it is appended: its rows go to a folder of their own below
``_history/batches``, then one row (batch, folder, time) to
``_history/commits``.  Readers take, for each batch, the folder that was
committed first; a folder without a commit (a run that broke off) is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.contract import HISTORY_TIME_FORMAT, PATIENT
from tabrisk.functions.expressions import risk_label
from tabrisk.operators.ranking import bottom_k

HISTORY_COLUMNS = ["timestamp", "model", "probability", "prediction"]


def history_schema(features: Sequence[str] = tuple(PATIENT.feature_names)) -> str:
    return ("timestamp string, model string, probability double, prediction string, "
            + ", ".join(f"`{f}` double" for f in features))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def history_rows(scored: DataFrame, model: str, features: Sequence[str],
                 prediction: str, probability: str | None) -> DataFrame:
    """One history row per scored row (F6 time, percent rounded to 2, P15)."""
    prob = (F.round(F.col(probability) * 100, 2) if probability else F.lit(None).cast("double"))
    return scored.select(
        F.date_format(F.current_timestamp(), HISTORY_TIME_FORMAT).alias("timestamp"),
        F.lit(model).alias("model"), prob.alias("probability"),
        risk_label(prediction).alias("prediction"),
        *[F.col(f).cast("double").alias(f) for f in features])


COMMITS = "batch string, folder string, committed long"


def _inner(path: str, kind: str) -> str:
    return f"{path.rstrip('/')}/_history/{kind}"


def committed(spark: SparkSession, path: str) -> DataFrame:
    """(batch, folder): the folder of each committed batch that counts."""
    log = _inner(path, "commits")
    if not _exists(spark, log):
        return spark.createDataFrame([], "batch string, folder string")
    return spark.read.schema(COMMITS).parquet(log).groupBy("batch").agg(
        F.min(F.struct("committed", "folder")).alias("first")).select("batch", F.col("first.folder").alias("folder"))


def append_history(rows: DataFrame, path: str, batch: str | None = None) -> bool:
    """Append only the new rows (new files; existing files untouched).
    With a ``batch`` id the append counts once: False if the batch was there."""
    if batch is None:
        rows.write.mode("append").partitionBy("model").parquet(path)
        return True
    spark = rows.sparkSession
    if not committed(spark, path).where(F.col("batch") == batch).isEmpty():
        return False
    folder = uuid.uuid4().hex
    (rows.withColumn("folder", F.lit(folder)).write.mode("append").partitionBy("folder", "model").parquet(_inner(path, "batches")))
    now = F.unix_micros(F.current_timestamp())
    spark.range(1).select(F.lit(batch).alias("batch"), F.lit(folder).alias("folder"), now.alias("committed")).coalesce(1).write.mode(
        "append").parquet(_inner(path, "commits"))
    return True


def load_history(spark: SparkSession, path: str,
                 features: Sequence[str] = tuple(PATIENT.feature_names)) -> DataFrame:
    """The history, or an empty frame with the fixed columns."""
    schema = history_schema(features)
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    names = [c.split(" ")[0].strip("`") for c in schema.split(", ")]
    plain = spark.read.schema(schema).parquet(path).select(*names)
    if not _exists(spark, _inner(path, "batches")):
        return plain
    # the commits are one row a batch; the join prunes the other folders
    rows = spark.read.schema(f"{schema}, folder string").parquet(_inner(path, "batches"))
    return plain.unionByName(rows.join(committed(spark, path).select("folder"), "folder", "left_semi").select(*names))


def clear_history(spark: SparkSession, path: str,
                  features: Sequence[str] = tuple(PATIENT.feature_names)) -> None:
    """Replace the history by an empty table of the same schema."""
    inner = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/_history")
    inner.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(inner, True)
    (spark.createDataFrame([], history_schema(features)).write.mode("overwrite")
        .option("partitionOverwriteMode", "static").partitionBy("model").parquet(path))


def models_in_history(history: DataFrame) -> DataFrame:
    """Distinct non-null models, sorted."""
    return history.select("model").where(F.col("model").isNotNull()).distinct().orderBy("model")


def history_counts(history: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """P12 + A17: counts by model and risk label (the bar chart's data)."""
    h = history.where(F.col("model").isin(*models)) if models else history
    return h.groupBy("model", "prediction").agg(F.count(F.lit(1)).alias("n"))


def newest_first(history: DataFrame, n: int | None = None) -> DataFrame:
    """T1 (+ T5): newest first, missing times last; with ``n`` the n newest
    per model (salted top-k), otherwise a full sort.  Rows of equal time are
    ordered by their other columns, so only equal rows can change places."""
    rest = [c for c in history.columns if c != "timestamp"]
    order = [F.col("timestamp").desc_nulls_last(), *[F.col(c) for c in rest]]
    if n is None:
        return history.orderBy(*order)
    return bottom_k(history, ["model"], order, n, salt_by=history.columns, out="recency")
