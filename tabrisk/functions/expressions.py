"""Scalar column expressions (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabrisk.contract import AUC_BAND_ELSE, AUC_BANDS, NA_WORDS, RISK_LABELS

# A number as pandas.to_numeric accepts it: optional sign, digits with an
# optional fraction and exponent, or inf / infinity / nan, spaces around.
# Spark's try_cast alone is too lenient ("5d", "5f" are doubles there).
NUMERIC_TEXT = (r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?"
                r"|[nN][aA][nN])\s*$")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def na_to_null(c) -> Column:
    """Cell text that is one of the NA words becomes null (CSV scan)."""
    c = col_(c)
    return F.when(c.isin(*NA_WORDS), F.lit(None).cast("string")).otherwise(c)


def nan_to_null(c) -> Column:
    """NaN becomes SQL NULL, so ranges, medians and distinct behave."""
    c = col_(c)
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def to_number(c) -> Column:
    """Text -> double; text that is not a number gives null (see ``is_bad_number``)."""
    c = col_(c).cast("string")
    return nan_to_null(F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double")))


def is_bad_number(c) -> Column:
    """Non-null text that does not parse as a number."""
    c = col_(c).cast("string")
    return c.isNotNull() & ~c.rlike(NUMERIC_TEXT)


def zero_to_null(c) -> Column:
    """A physiologically impossible zero is a missing value; so is NaN."""
    c = nan_to_null(col_(c).cast("double"))
    return F.when(c == 0, F.lit(None).cast("double")).otherwise(c)


def impute(c, median: float) -> Column:
    """fill null with the fitted median."""
    return F.coalesce(col_(c).cast("double"), F.lit(float(median)))


def scale_clip(c, lo: float, hi: float) -> Column:
    """(x - min) / range clipped to [0, 1]; a constant column scales to 0."""
    span = float(hi) - float(lo)
    if span == 0.0:
        span = 1.0
    x = (col_(c) - F.lit(float(lo))) / F.lit(span)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def risk_label(pred) -> Column:
    """Class 1 -> High Risk, else Low Risk."""
    return F.when(col_(pred) == 1, F.lit(RISK_LABELS[1])).otherwise(F.lit(RISK_LABELS[0]))


def auc_band(auc) -> Column:
    """Excellent / Good / Fair / Poor, null AUC stays null."""
    auc = col_(auc)
    out = None
    for bound, name in AUC_BANDS:
        out = F.when(auc >= bound, F.lit(name)) if out is None else out.when(auc >= bound, F.lit(name))
    return F.when(auc.isNull(), F.lit(None).cast("string")).otherwise(out.otherwise(F.lit(AUC_BAND_ELSE)))


def safe_ratio(num, den, zero=0.0) -> Column:
    """num / den, ``zero`` when den is 0 (ANSI mode raises on plain /)."""
    num, den = col_(num).cast("double"), col_(den).cast("double")
    return F.when(den == 0, F.lit(zero)).otherwise(num / den)


def percent_text(pct, n) -> Column:
    """a confusion cell as 'percent newline count'."""
    return F.format_string("%.1f%%\n%d", col_(pct), col_(n))


def number_text(x, digits: int = 4, signed: bool = False) -> Column:
    """a number with ``digits`` places, with its sign if ``signed``; null stays null."""
    return F.when(col_(x).isNotNull(), F.format_string(f"%{'+' if signed else ''}.{digits}f", col_(x)))


def title_case(x) -> Column:
    """F8: every word with a capital, the rest in small letters."""
    return F.initcap(F.lower(col_(x)))


def strip_param_prefix(m, prefix: str = "model__") -> Column:
    """keep only keys with the prefix and remove it."""
    kept = F.map_filter(col_(m), lambda k, v: k.startswith(prefix))
    return F.transform_keys(kept, lambda k, v: F.regexp_replace(k, "^" + prefix, ""))


def hash_key(seed: int, *cols) -> Column:
    """md5 of 'seed-k1-k2...' as lowercase hex.  The same text in DuckDB gives
    the same digest, so a hash order can be checked by SQL."""
    parts = [F.lit(str(seed))] + [col_(c).cast("string") for c in cols]
    return F.md5(F.concat_ws("-", *parts))
