"""Provenance audit and duplicates.

All of it is grouping and anti joins.  Before any join both sides are
collapsed to distinct rows with counts (partial aggregation runs map-side),
so a block that is a third of the table made of one repeated row costs one
row per task in the shuffle, not a third of the table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows, distinct rows, repeats (first copy not counted,
    null equals null as in group by), groups with copies, largest group."""
    g = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.sum("_c").cast("long").alias("n_rows"),
                 F.count(F.lit(1)).alias("n_distinct"),
                 F.sum(F.col("_c") - 1).cast("long").alias("n_repeats"),
                 F.sum(F.when(F.col("_c") > 1, 1).otherwise(0)).cast("long").alias("n_groups_with_copies"),
                 F.max("_c").cast("long").alias("max_copies"))


def keep_first(df: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """U4: one row per distinct ``cols``, the one with the smallest ``order``,
    plus how many copies there were.  ``min_by`` is a plain aggregate, so a
    hot group is combined map-side instead of ranked in one task."""
    others = [c for c in df.columns if c not in cols]
    g = df.groupBy(*cols).agg(F.min_by(F.struct(*others), F.col(order)).alias("_k"),
                              F.count(F.lit(1)).alias("copies"))
    return g.select(*cols, "_k.*", "copies")


def not_contained(block: DataFrame, reference: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Distinct rows of ``block`` (with their counts) that do not
    occur in ``reference`` on ``cols``.  Plain equality, so a row with a null
    never matches (as a tuple with NaN never equals another)."""
    b = block.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    r = reference.select(*cols).distinct()
    cond = [b[c] == r[c] for c in cols]
    return b.join(r, cond, "left_anti")


def provenance_audit(df: DataFrame, position: str, cols: Sequence[str],
                     original_end: int, duplicate_end: int,
                     expected_rows: int | None) -> DataFrame:
    """E17 as a report: one row per rule with ``passed`` 0/1 and the count of
    offending rows.  Blocks are positions [1, original_end] and
    (original_end, duplicate_end] of the 1-based ``position`` column (P10)."""
    pos = F.col(position)
    original = df.where(pos <= original_end)
    dup = df.where((pos > original_end) & (pos <= duplicate_end))
    n = df.agg(F.count(F.lit(1)).alias("v")).select(
        F.lit("row_count").alias("rule"), F.col("v").cast("long").alias("value"))
    repeats = duplicate_stats(original, cols).select(
        F.lit("original_unique").alias("rule"),
        F.coalesce(F.col("n_repeats"), F.lit(0)).cast("long").alias("value"))
    missing = not_contained(dup, original, cols).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("value")).select(
        F.lit("duplicate_block_in_original").alias("rule"), "value")
    out = n.unionByName(repeats).unionByName(missing)
    expect = F.lit(expected_rows).cast("long") if expected_rows is not None else F.lit(None).cast("long")
    return out.select(
        "rule", "value",
        F.when(F.col("rule") == "row_count", expect).otherwise(F.lit(0).cast("long")).alias("expected"),
    ).withColumn("passed", F.when(F.col("expected").isNull(), F.lit(None).cast("int"))
                 .otherwise((F.col("value") == F.col("expected")).cast("int")))
