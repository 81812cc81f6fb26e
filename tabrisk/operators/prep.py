"""Preprocessing fitted on training rows only, applied anywhere.

fit       = zero -> null on the flagged columns (P9), exact median (A1) and
            min / max (A2) of every feature over the training rows;
transform = zero -> null, fill with the median (F1), scale to 0-1 and clip
            (F2).  Pure column expressions with the fitted numbers as
            literals: no shuffle, works on streaming frames too.

``RiskPreprocessor`` is a ``pyspark.ml`` Estimator, so it sits in a
``Pipeline`` and saves with ``PipelineModel.write()`` (S12).
"""

from __future__ import annotations

import math

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabrisk.functions.expressions import impute, nan_to_null, scale_clip, zero_to_null
from tabrisk.operators.quantiles import column_stats, exact_medians


class _PrepParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "feature columns in order",
                      typeConverter=TypeConverters.toListString)
    zeroMissingCols = Param(Params._dummy(), "zeroMissingCols",
                            "columns where 0 means missing",
                            typeConverter=TypeConverters.toListString)
    outputSuffix = Param(Params._dummy(), "outputSuffix",
                         "suffix of the scaled columns ('' replaces in place)",
                         typeConverter=TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(zeroMissingCols=[], outputSuffix="")

    def getInputCols(self):
        return self.getOrDefault(self.inputCols)

    def getZeroMissingCols(self):
        return self.getOrDefault(self.zeroMissingCols)

    def getOutputSuffix(self):
        return self.getOrDefault(self.outputSuffix)


class RiskPreprocessor(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, inputCols=None, zeroMissingCols=None, outputSuffix=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "RiskPreprocessorModel":
        cols = self.getInputCols()
        zero = set(self.getZeroMissingCols())
        # The fit makes 2-3 passes (count/min/max, median bins, final pick);
        # only the narrow feature projection is kept between them, spilling
        # to executor disk when it does not fit, and released afterwards.
        clean = df.select(*[(zero_to_null(c) if c in zero else nan_to_null(F.col(c).cast("double"))).alias(c)
                            for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            stats = column_stats(clean, cols)
            empty = [c for c in cols if not stats[c][0]]
            if empty:
                # checked after zero replacement: an all-zero flagged column is empty too
                raise ValueError("completely empty features: " + ", ".join(empty))
            endless = [c for c in cols if math.isinf(stats[c][1]) or math.isinf(stats[c][2])]
            if endless:
                raise ValueError("infinite values in: " + ", ".join(endless))
            med = exact_medians(clean, cols, stats)
        finally:
            clean.unpersist()
        model = RiskPreprocessorModel(
            inputCols=cols, zeroMissingCols=sorted(zero), outputSuffix=self.getOutputSuffix(),
            medians=[med[c] for c in cols], mins=[stats[c][1] for c in cols],
            maxs=[stats[c][2] for c in cols])
        return model


class RiskPreprocessorModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)
    mins = Param(Params._dummy(), "mins", "fitted minimums", TypeConverters.toListFloat)
    maxs = Param(Params._dummy(), "maxs", "fitted maximums", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, inputCols=None, zeroMissingCols=None, outputSuffix=None,
                 medians=None, mins=None, maxs=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def stats(self) -> dict[str, tuple[float, float, float]]:
        return {c: (m, lo, hi) for c, m, lo, hi in zip(
            self.getInputCols(), self.getOrDefault(self.medians),
            self.getOrDefault(self.mins), self.getOrDefault(self.maxs))}

    def column_exprs(self, keep: list[str] | None = None) -> dict[str, object]:
        zero = set(self.getZeroMissingCols())
        out = {}
        for c, (m, lo, hi) in self.stats().items():
            if keep is not None and c not in keep:
                continue
            x = zero_to_null(c) if c in zero else nan_to_null(F.col(c).cast("double"))
            out[c] = scale_clip(impute(x, m), lo, hi)
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        suffix = self.getOutputSuffix()
        exprs = self.column_exprs()
        return df.withColumns({c + suffix: e for c, e in exprs.items()})


def pooled_variance(df: DataFrame, cols) -> float:
    """Population variance of all non-null values of ``cols`` together."""
    row = df.agg(*[f(c) for c in cols for f in (F.count, F.avg, F.var_pop)]).first()
    parts = [row[i:i + 3] for i in range(0, len(row), 3) if row[i]]
    n = sum(k for k, _, _ in parts)
    mean = sum(k * m for k, m, _ in parts) / n
    return sum(k * (v + (m - mean) ** 2) for k, m, v in parts) / n
