"""Driver tables (parquet) and the patient-like views derived from them.

Every loader selects only the columns it needs, so the parquet scan's
``ReadSchema`` is pruned and filters written later push down.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.contract import EMBED_FEATURES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def lineitem_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a patient table: 4 features, label = returnflag R."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        (F.col("l_returnflag") == "R").cast("int").alias("label"))


LINEITEM_KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
LINEITEM_TIEBREAK = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def embed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as a feature table: every dimension a column, class = label
    < 5.  A vector of another length is an error, not cut."""
    n = len(EMBED_FEATURES)
    x = F.when(F.size("embedding") == n, F.col("embedding")).otherwise(
        F.raise_error(F.lit(f"embeddings: a vector does not have {n} dimensions")))
    em = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("embedding"), "label")
    return em.select(
        "vec_id",
        *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(EMBED_FEATURES)],
        (F.col("label") < 5).cast("int").alias("label"))


def embed_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings with the whole 64-dim vector as array<double>."""
    em = table(spark, sf_dir, "embeddings")
    return em.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("vec"),
                     (F.col("label") < 5).cast("int").alias("label"))
