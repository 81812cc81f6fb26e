"""Saved models, the registry of what exists, freshness signatures.

A model folder holds one saved ``PipelineModel`` per model name.  The
registry is a small table built from a file-system listing (Hadoop FS, so it
works on HDFS / object stores), never from loading the models.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.contract import MODEL_NAMES


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def model_registry(spark: SparkSession, root: str, names: Sequence[str] = MODEL_NAMES) -> DataFrame:
    """(model, path, fitted_at) for the expected models whose folder
    exists under ``root``."""
    rows = []
    p, fs = _fs(spark, root)
    if fs.exists(p):
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            for m in names:
                if name.lower() == m.lower() and st.isDirectory():
                    rows.append((m, st.getPath().toString(), st.getModificationTime()))
    df = spark.createDataFrame(rows, "model string, path string, modified_ms long")
    return df.select("model", "path", F.timestamp_millis("modified_ms").alias("fitted_at"))


def missing_models(registry: DataFrame, names: Sequence[str] = MODEL_NAMES) -> DataFrame:
    """Expected models without an artefact (anti join)."""
    spark = registry.sparkSession
    expected = spark.createDataFrame([(m,) for m in names], "model string")
    return expected.join(registry, "model", "left_anti")


def artifact_signature(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, modification time, size) of every file under the given
    artefact folders -- the content column is never read."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
          .select("path", "modificationTime", "length"))
    return df


def content_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of every uploaded file's bytes, computed on the
    executors."""
    return (spark.read.format("binaryFile").load(path)
            .select("path", F.sha2(F.col("content"), 256).alias("sha256"), "length"))


def pending(batches: DataFrame, scored: DataFrame, keys: Sequence[str] = ("sha256", "model_version")) -> DataFrame:
    """Batches whose (content hash, model version) was not scored yet."""
    return batches.join(scored.select(*keys).distinct(), list(keys), "left_anti")
