"""Structured Streaming form of batch scoring + history append.

New CSV batches dropped in a folder are read as text, checked against the
contract, preprocessed with the fitted statistics and scored by every
column-only model; good rows are appended to the history (exactly once,
through the file sink's commit log), bad rows go to a violations sink.

Everything here is stateless (column expressions and the per-row contract
check), so there is no watermark or state store; the query survives restarts
from its checkpoint folder, which must be on shared storage.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabrisk.contract import HISTORY_TIME_FORMAT, TableContract
from tabrisk.functions.expressions import na_to_null, risk_label, to_number
from tabrisk.operators.validate import is_valid_row, violation_array
from tabrisk.sources.files import csv_reader


def text_stream(spark: SparkSession, folder: str, columns: Sequence[str],
                max_files_per_trigger: int = 100) -> DataFrame:
    """New CSV files as text; a file whose header names other columns, or the
    same in another order, stops the query instead of shifting values."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = (csv_reader(spark.readStream.schema(schema))
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(folder))
    return raw.select(*[na_to_null(F.col(f"`{c}`")).alias(c) for c in columns])


def scored_history(batch: DataFrame, contract: TableContract, prep, models) -> DataFrame:
    """Rows without violations -> one history row per (row, model)."""
    feats = contract.feature_names
    good = batch.where(is_valid_row(contract, text=True))
    typed = good.select(*[to_number(c).alias(c) for c in feats])
    x = prep.transform(typed.select(*[F.col(c).alias(f"raw_{c}") for c in feats], *feats))
    out = x
    for m in models:
        out = m.score(out)
    rows = [F.struct(F.lit(m.name).alias("model"),
                     F.round(F.col(f"{m.name.lower()}_probability") * 100, 2).alias("probability"),
                     risk_label(f"{m.name.lower()}_prediction").alias("prediction")) for m in models]
    return out.select(F.date_format(F.current_timestamp(), HISTORY_TIME_FORMAT).alias("timestamp"),
                      *[F.col(f"raw_{c}").alias(c) for c in feats], F.inline(F.array(*rows)))


def stream_violations(batch: DataFrame, contract: TableContract) -> DataFrame:
    """The incoming rows that break a rule, as text, with their bad cells
    (column, rule, value), for a quarantine sink: each row goes either there
    or to the history."""
    return batch.where(~is_valid_row(contract, text=True)).withColumn("violations", violation_array(contract, text=True))


class ScoringStreams(NamedTuple):
    """The two queries of a scoring stream."""
    history: StreamingQuery
    violations: StreamingQuery

    def awaitTermination(self, timeout: int | None = None) -> bool:
        return all([q.awaitTermination(timeout) for q in self])

    def stop(self) -> None:
        for q in self:
            q.stop()


def start_scoring_stream(spark: SparkSession, in_folder: str, history_path: str, checkpoint: str,
                         contract: TableContract, prep, models, trigger_once: bool = False,
                         violations_path: str | None = None) -> ScoringStreams:
    """Start both sinks: scored rows to the history, partitioned by model, and
    bad rows to ``violations_path`` (``<history_path>-violations`` if not
    given).  Each has a checkpoint of its own below ``checkpoint``."""
    src = text_stream(spark, in_folder, contract.feature_names)

    def start(df, path, name, by=()):
        w = (df.writeStream.format("parquet").option("path", path)
             .option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}").outputMode("append"))
        w = w.partitionBy(*by) if by else w
        return (w.trigger(availableNow=True) if trigger_once else w).start()

    return ScoringStreams(
        start(scored_history(src, contract, prep, models), history_path, "history", ["model"]),
        start(stream_violations(src, contract), violations_path or f"{history_path.rstrip('/')}-violations", "violations"))
