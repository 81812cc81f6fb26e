"""Mixing sources to target weights by iterative proportional fitting.

1. Every document gets its cell (source, language, topic) and its tokens
   (words).  Tokens are summed by cell.
2. Raking: the cell weights are scaled to each marginal's target in turn until
   all marginals hold.
3. Calibration: a cell is kept with probability min(1, s * weight / tokens),
   with s such that the expected tokens are the budget's share of all tokens.
4. Sampling: a document stays if a hash of its id, as a number in [0, 1), is
   below its cell's probability.

Only the cell table (values of the three dimensions that occur together)
reaches the driver; from ``MAX_CELLS`` cells on it stays in Spark, where the
same sweeps are grouped sums and the scale is found by exact steps.
"""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabrisk.llm import textscan
from tabrisk.llm.spark_util import free_names, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

MAX_CELLS = 1_000_000
#: Target share of a value: its share of all tokens to this power, normalised.
POWER = 0.7
BUDGET = 0.9
SWEEPS = 30
DIMS = ("source", "lang", "topic")
SYMBOLS = textscan.byte_class(b"#*$%&")
CAPITALS = textscan.byte_class(range(0x41, 0x5B))


def describe(column) -> tuple[np.ndarray, np.ndarray]:
    """(words, topic) of each text.  The topic is the text's form: ``symbols``
    (a twentieth or more of its characters are symbols), ``caps`` (a third are
    A-Z), ``table`` (a fiftieth are bars), else ``prose``."""
    n = len(column)
    tokens, topic = np.zeros(n, np.int64), np.full(n, "prose", object)
    for first, last, data, offsets in textscan.slices(column):
        starts, _ = textscan.runs(data, offsets, textscan.NOT_SPACE)
        tokens[first:last] = np.bincount(np.searchsorted(offsets, starts, "right") - 1, minlength=last - first)

        def count(mask):
            sums = np.concatenate([[0], np.cumsum(mask)])
            return sums[offsets[1:]] - sums[offsets[:-1]]

        chars = count((data & 0xC0) != 0x80)
        some = chars > 0
        rules = [("table", 50 * count(data == 0x7C) >= chars), ("caps", 3 * count(CAPITALS[data]) >= chars),
                 ("symbols", 20 * count(SYMBOLS[data]) >= chars)]
        for name, hit in rules:  # the first rule of the docstring wins
            topic[first:last][some & hit] = name
    return tokens, topic


def level(c):
    """A dimension's value as text; null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))


def rake(weights: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray],
         sweeps: int = SWEEPS) -> np.ndarray:
    """Scale cell weights until they sum to targets[d][v] over the cells with
    codes[d] == v, for each dimension d."""
    w = weights.astype(float)
    for _ in range(sweeps):
        for code, target in zip(codes, targets):
            sums = np.bincount(code, w, len(target))
            w = w * np.divide(target, sums, out=np.zeros_like(target), where=sums > 0)[code]
    return w


def calibrate(tokens: np.ndarray, weights: np.ndarray, budget: float = BUDGET) -> np.ndarray:
    """Keeping probabilities min(1, s * weight / tokens) whose expected tokens
    are ``budget`` of all; cells without tokens are kept whole."""
    total = tokens.sum()
    ratio = np.divide(weights, tokens, out=np.full(len(tokens), np.inf), where=tokens > 0)
    order = np.argsort(-ratio, kind="stable")
    t, w = tokens[order].astype(float), weights[order]
    full = np.concatenate([[0.0], np.cumsum(t)])[:-1]  # tokens of cells kept whole before this one
    rest = w[::-1].cumsum()[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        s = np.where(rest > 0, (budget * total - full) / rest, np.inf)
        ok = (s * np.where(np.isinf(ratio[order]), 0, ratio[order]) <= 1) & np.isfinite(ratio[order])
    scale = s[np.argmax(ok)] if ok.any() else np.inf
    with np.errstate(invalid="ignore"):
        return np.where(np.isfinite(ratio), np.minimum(1.0, max(scale, 0.0) * np.where(np.isfinite(ratio), ratio, 0)), 1.0) \
            if np.isfinite(scale) else np.ones(len(tokens))


def power_targets(shares: np.ndarray, power: float = POWER) -> np.ndarray:
    out = shares ** power
    return out / out.sum() if out.sum() > 0 else out


def probabilities(cells: pd.DataFrame, targets: dict | None = None, budget: float = BUDGET,
                  power: float = POWER, sweeps: int = SWEEPS) -> pd.DataFrame:
    """Raked weight and keeping probability of each cell (columns of DIMS and
    ``tokens``).  ``targets``: {dimension: {value: share}}, else powers of the
    natural shares."""
    tokens = cells["tokens"].to_numpy(np.int64)
    total = float(tokens.sum())
    codes, goals = [], []
    for d in DIMS:
        code, values = pd.factorize(cells[d], sort=True)
        own = np.bincount(code, tokens, len(values))
        wanted = (targets or {}).get(d)
        share = np.array([wanted.get(v, 0.0) for v in values]) if wanted else power_targets(own / max(total, 1.0), power)
        codes.append(code)
        goals.append(share * total)
    weight = rake(tokens, codes, goals, sweeps)
    return cells.assign(weight=weight, p=calibrate(tokens, weight, budget))


def with_cells(docs: DataFrame, text_col: str = "text", keep_text: bool = True,
               cell: tuple = ("_source", "_lang", "_topic", "_tokens")) -> DataFrame:
    """``docs`` with its cell, in columns named by ``cell``."""
    keyed = docs.withColumn(cell[0], level("source")).withColumn(cell[1], level("lang"))
    at = docs.columns.index(text_col)
    kept = [i for i, c in enumerate(keyed.columns) if keep_text or c != text_col]
    schema = T.StructType([keyed.schema[i] for i in kept] + [T.StructField(cell[2], T.StringType()), T.StructField(cell[3], T.LongType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            tokens, topic = describe(batch.column(at))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(topic, pa.string()), pa.array(tokens)], names=names)

    return keyed.mapInArrow(run, schema)


def marginal_goals(cells: DataFrame, name: str, wanted: dict | None, total: float, power: float) -> DataFrame:
    """(name, goal): target tokens of each value of one dimension."""
    own = cells.groupBy(name).agg(F.sum("tokens").alias("own"))
    if wanted:
        # a given target table lists its values, so it is as small as the caller wrote it
        given = cells.sparkSession.createDataFrame([(v, float(x)) for v, x in wanted.items()], f"{name} string, share double")
        return own.join(given, name, "left").select(name, (F.coalesce("share", F.lit(0.0)) * total).alias("goal"))
    own = written(own.select(name, F.pow(F.col("own") / max(total, 1.0), F.lit(power)).alias("share")), "shares")
    every = own.agg(F.sum("share")).first()[0]
    return own.select(name, (F.col("share") / (every if every else 1.0) * total).alias("goal"))


def raked(cells: DataFrame, goals: dict[str, DataFrame], sweeps: int) -> DataFrame:
    """``cells`` with its raked weight.  A weight is the cell's tokens times a
    factor of each dimension's value; a step sums the weights without one
    dimension's factor and sets that factor anew.  Only the factor tables,
    one row a value, are written from step to step."""
    factors = {d: goal.select(d, F.lit(1.0).alias(f"f{d}")) for d, goal in goals.items()}

    def weighed(dims):
        out, weight = cells, F.col("tokens").cast("double")
        for d in dims:
            out, weight = out.join(factors[d], d), weight * F.col(f"f{d}")
        return out.withColumn("weight", weight)

    for _ in range(sweeps):
        for d, goal in goals.items():
            sums = weighed([k for k in goals if k != d]).groupBy(d).agg(F.sum("weight").alias("sum"))
            factor = F.when(F.col("sum") > 0, F.col("goal") / F.col("sum")).otherwise(0.0)
            factors[d] = written(sums.join(goal, d).select(d, factor.alias(f"f{d}")), "factors")
    return weighed(goals).select(*cells.columns, "weight")


def calibrated(cells: DataFrame, budget: float) -> DataFrame:
    """``cells`` (tokens, weight) with p as ``calibrate`` gives it.  The
    expected tokens of a scale s are concave in s, so steps to the root of the
    tangent rise to the scale and end there, after as many sums as steps."""
    ratio = F.col("weight") / F.col("tokens")
    some = cells.where("tokens > 0")
    scale, whole = 0.0, -1
    while True:
        full = F.col("weight") * scale >= F.col("tokens")
        row = some.agg(F.sum("tokens"), F.count(F.when(full, True)), F.sum(F.when(full, F.col("tokens"))),
                       F.sum(F.when(~full, F.col("weight")))).first()
        want = budget * (row[0] or 0)
        if row[1] == whole:
            break
        whole = row[1]
        if not row[3]:  # no weight is left to scale: the budget takes all cells
            return cells.withColumn("p", F.lit(1.0))
        scale = max((want - (row[2] or 0)) / row[3], 0.0)
    return cells.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), ratio * scale)).otherwise(1.0))


def large_cell_probabilities(sums: DataFrame, targets: dict | None, budget: float, power: float,
                             sweeps: int = SWEEPS) -> DataFrame:
    """``probabilities`` of cells in a DataFrame of any size."""
    cells = written(sums, "cells")
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    goals = {f"_{d}": written(marginal_goals(cells, f"_{d}", (targets or {}).get(d), total, power), "goals") for d in DIMS}
    weighted = written(raked(cells, goals, sweeps), "weights")
    return calibrated(weighted, budget).select(*goals, "weight", "p")


def cell_probabilities(celled: DataFrame, targets: dict | None = None, budget: float = BUDGET,
                       power: float = POWER) -> DataFrame:
    """The cells of ``celled`` with raked weights and probabilities, as a DataFrame."""
    names = [f"_{d}" for d in DIMS]
    sums = celled.groupBy(*names).agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    rows = sums.limit(MAX_CELLS + 1).toPandas()
    if len(rows) > MAX_CELLS:
        return large_cell_probabilities(sums, targets, budget, power)
    rows = rows.rename(columns=dict(zip(names, DIMS))).sort_values(list(DIMS)).reset_index(drop=True)
    done = probabilities(rows, targets, budget, power)
    schema = "_source string, _lang string, _topic string, weight double, p double"
    data = list(zip(done["source"], done["lang"], done["topic"], done["weight"].astype(float), done["p"].astype(float)))
    return celled.sparkSession.createDataFrame(data, schema)


def uniform(id_col: str):
    """A number in [0, 1) from the id (equal ids: the same; null: as '')."""
    hexed = F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 13)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(16 ** 13))


def mix(docs: DataFrame, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
        budget: float = BUDGET, power: float = POWER) -> DataFrame:
    """(id, source, lang, topic, tokens, p, kept) of every row of ``docs``
    (columns source and lang are needed).

    Null source or language: a value of its own.  Null and empty texts have no
    tokens; a cell without tokens is kept whole.  Repeated rows share their
    decision.  Extra columns are ignored; an empty table gives no row.
    """
    celled = written(with_cells(docs.select(id_col, text_col, "source", "lang"), text_col, False), "cells")
    p = cell_probabilities(celled, targets, budget, power)
    return (celled.join(p, [f"_{d}" for d in DIMS])
                  .select(id_col, "source", "lang", F.col("_topic").alias("topic"), F.col("_tokens").alias("tokens"),
                          "weight", "p", (uniform(id_col) < F.col("p")).alias("kept")))


def sample(docs: DataFrame, targets: dict | None = None, id_col: str = "doc_id", text_col: str = "text",
           budget: float = BUDGET, power: float = POWER) -> DataFrame:
    """The rows of ``docs`` that the mix keeps, with all columns.  Cells are
    summed in a first pass; the second joins the cell table to the rows, which
    moves no text as long as the planner can broadcast that table.  Null
    sources, languages and texts are values of their own; repeated rows and
    rows of one id (null too) share their decision; columns of any name stay;
    an empty table stays empty; a very long text is read whole."""
    cell = free_names(docs, "_source", "_lang", "_topic", "_tokens")
    share, = free_names(docs, "_p")
    p = cell_probabilities(with_cells(docs.select(text_col, "source", "lang"), text_col, False), targets, budget, power)
    p = p.select(*[F.col(f"_{d}").alias(c) for d, c in zip(DIMS, cell)], F.col("p").alias(share))
    return (with_cells(docs, text_col, cell=tuple(cell)).join(p, cell[:3])
            .where(uniform(id_col) < F.col(share)).select(*docs.columns))
