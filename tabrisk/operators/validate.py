"""Validation of raw tables against a contract.

Schema rules (required / extra columns) are checked on ``df.columns`` before
any job.  Value rules run in ONE pass that emits a long table of violations
(row_id, column, rule, value); reports and the good/bad row split are built
from it, so a table is scanned once however many rules there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.contract import TableContract
from tabrisk.functions.expressions import is_bad_number, nan_to_null, to_number
from tabrisk.operators.ranking import bottom_k

FIRST_ROWS = 10


class ContractError(ValueError):
    pass


def check_schema(columns: Sequence[str], contract: TableContract,
                 need_target: bool = False) -> list[str]:
    """Raise naming every missing column; return the extra ones
    (reported and then ignored)."""
    required = contract.feature_names + ([contract.target] if need_target and contract.target else [])
    missing = [c for c in required if c not in columns]
    if missing:
        raise ContractError("missing required columns: " + ", ".join(missing))
    known = set(required) | {contract.row_id, contract.target} | set(contract.extras)
    return [c for c in columns if c not in known]


def typed(df: DataFrame, contract: TableContract, text: bool) -> DataFrame:
    """P1 + P4 + F14: the feature columns in contract order as doubles
    (NaN and non-numbers become null), keeping row id and target."""
    keep = [c for c in (contract.row_id, contract.target) if c and c in df.columns]
    conv = [(to_number(c) if text else nan_to_null(F.col(c).cast("double"))).alias(c)
            for c in contract.feature_names]
    return df.select(*keep, *conv)


def violation_array(contract: TableContract, text: bool = False, ranges: bool = True):
    """Array of (column, rule, value) structs for the bad cells of a row:
    a pure column expression (works on streaming frames)."""
    checks = []
    for r in contract.features:
        raw = F.col(r.name)
        num = to_number(raw) if text else nan_to_null(raw.cast("double"))
        shown = raw.cast("string")

        def item(cond, rule, name=r.name, shown=shown):
            return F.when(cond, F.struct(F.lit(name).alias("column"), F.lit(rule).alias("rule"),
                                         shown.alias("value")))

        if text:
            checks.append(item(is_bad_number(raw), "non_numeric"))
        if ranges and (r.low is not None or r.high is not None):
            out = F.lit(False)
            if r.low is not None:
                out = out | (num < F.lit(float(r.low)))
            if r.high is not None:
                out = out | (num > F.lit(float(r.high)))
            checks.append(item(num.isNotNull() & out, "range"))
        if r.whole_number:
            checks.append(item(num.isNotNull() & (num % 1 != 0), "whole_number"))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def is_valid_row(contract: TableContract, text: bool = False, ranges: bool = True):
    """True when a row breaks no value rule (no join needed)."""
    return F.size(violation_array(contract, text, ranges)) == 0


def violations(df: DataFrame, contract: TableContract, row_id: str,
               text: bool = False, ranges: bool = True) -> DataFrame:
    """(row_id, column, rule, value) for every bad cell, in one pass.

    rules: ``non_numeric`` (text that does not parse, P4), ``range`` (outside
    the closed range, nulls pass, P5), ``whole_number`` (P6)."""
    arr = violation_array(contract, text, ranges)
    return df.select(F.col(row_id).alias("row_id"), F.explode(arr).alias("v")).select("row_id", "v.*")


def violation_report(viol: DataFrame, first: int = FIRST_ROWS) -> DataFrame:
    """Per (column, rule) the number of bad rows and the first
    ``first`` row numbers.  The first rows come from a salted two-stage
    top-k, so a rule that fails on most rows is not one task's work."""
    counts = viol.groupBy("column", "rule").agg(F.count(F.lit(1)).alias("n_bad"))
    firsts = (bottom_k(viol, ["column", "rule"], ["row_id"], first, salt_by=["row_id"])
              .groupBy("column", "rule")
              .agg(F.array_sort(F.collect_list("row_id")).alias("_ids")))   # <= first ids
    return (counts.join(firsts, ["column", "rule"])
                  .select("column", "rule", "n_bad",
                          F.array_join(F.transform("_ids", lambda x: x.cast("string")), ",")
                          .alias("first_rows")))


def split_valid(df: DataFrame, viol: DataFrame, row_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows without / with a violation (anti / semi join on the row id;
    the violation ids are de-duplicated first, map-side)."""
    bad_ids = viol.select(F.col("row_id").alias(row_id)).distinct()
    return df.join(bad_ids, row_id, "left_anti"), df.join(bad_ids, row_id, "left_semi")


def raise_on_violations(viol: DataFrame, first: int = FIRST_ROWS) -> None:
    """The reference's behaviour for a scoring batch: stop on the first bad
    column with its first row numbers (only a small report reaches the driver)."""
    rows = violation_report(viol, first).orderBy("column", "rule").limit(1).collect()
    if rows:
        r = rows[0]
        raise ContractError(f"'{r['column']}' fails rule {r['rule']} at rows [{r['first_rows']}]")


def empty_columns(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns with no non-null value (one aggregate)."""
    row = df.agg(*[F.count(c).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] == 0]


def label_domain_bad(df: DataFrame, target: str, values: Sequence[int] = (0, 1)) -> DataFrame:
    """Rows whose target is null or outside ``values``."""
    t = F.col(target)
    return df.where(F.coalesce(~t.isin(*values), F.lit(True)))
