"""S15 + J1: reports that models left as tables, found, merged side by side,
and the missing ones named."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.contract import MODEL_NAMES
from tabrisk.sources.registry import model_registry


def find_reports(spark: SparkSession, root: str, names: Sequence[str] = MODEL_NAMES) -> tuple[dict[str, DataFrame], list[str]]:
    """({name: report} of the expected names whose folder is below ``root``, names without one)."""
    found = {r["model"]: spark.read.parquet(r["path"]) for r in model_registry(spark, root, names).collect()}
    return found, [n for n in names if n not in found]


def merge_reports(reports: dict[str, DataFrame], key: str, values: Sequence[str], names: Sequence[str] = MODEL_NAMES,
                  key_type: str = "string", value_type: str = "double") -> DataFrame:
    """A full outer merge by ``key``: one row for each key that any report has,
    columns ``<name>_<value>`` for every expected name, null where a report or
    its row is missing.  A report's repeated key is an error; null keys are one
    key.  Without reports the result is empty."""
    out = None
    for name, df in reports.items():
        repeated = df.groupBy(key).count().where("count > 1").limit(1).collect()
        if repeated:
            raise ValueError(f"{name}: the key {repeated[0][0]!r} is repeated")
        part = df.select(F.col(key).alias(f"_{name}"), *[F.col(v).alias(f"{name.lower()}_{v}") for v in values])
        if out is None:
            out = part.withColumnRenamed(f"_{name}", key)
        else:
            out = out.join(part, F.col(key).eqNullSafe(F.col(f"_{name}")), "full")
            # a key that only the new report has; a null key that both have stays null
            out = out.withColumn(key, F.coalesce(F.col(key), F.col(f"_{name}"))).drop(f"_{name}")
    if out is None:
        return SparkSession.getActiveSession().createDataFrame([], ", ".join([f"`{key}` {key_type}", *[f"{n.lower()}_{v} {value_type}" for n in names for v in values]]))
    have = set(out.columns)
    return out.select(key, *[F.col(c) if c in have else F.lit(None).cast(value_type).alias(c)
                             for c in (f"{n.lower()}_{v}" for n in names for v in values)])
