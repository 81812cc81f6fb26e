"""A1/A2: exact median, min and max of many columns at scale.

``F.median`` is exact but keeps a value->count map per group in one final
task, which does not hold for a continuous column over billions of rows.
Here the median is found by histogram refinement:

pass 0  count / min / max of every column (one aggregate; also A2);
pass k  for each column, a 1024-bin histogram of the values inside the
        current range, with each bin's real min and max (partial+final
        aggregate, at most columns x 1024 rows come back);
        keep the bin that holds the middle rank(s) and its real bounds;
final   once a range holds at most ``final_rows`` values, their distinct
        values with counts (bounded) decide the exact answer.

Each pass divides the range by about 1024, so a few passes suffice even for
skewed data; one value that holds a third of the rows ends the search early
(its bin has min == max).  The result equals the interpolated median (mean of
the two middle values for an even count), nulls skipped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

N_BINS = 1024
FINAL_ROWS = 4096


def _long_values(df: DataFrame, cols: Sequence[str], ranges: dict[int, tuple[float, float]]):
    """(i, v) for the columns still searched, inside their current range."""
    pairs = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("v"))
                      for i, c in enumerate(cols) if i in ranges])
    long = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
    cond = None
    for i, (lo, hi) in ranges.items():
        c = (F.col("i") == i) & F.col("v").between(lo, hi)
        cond = c if cond is None else (cond | c)
    return long.where(cond)


def column_stats(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[int, float, float]]:
    """count of non-null, min, max per column, one aggregate."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.count(x), F.min(x), F.max(x)]
    row = df.agg(*aggs).first()
    return {c: (row[3 * i], row[3 * i + 1], row[3 * i + 2]) for i, c in enumerate(cols)}


def exact_medians(df: DataFrame, cols: Sequence[str],
                  stats: dict[str, tuple[int, float, float]] | None = None,
                  n_bins: int = N_BINS, final_rows: int = FINAL_ROWS) -> dict[str, float | None]:
    stats = stats or column_stats(df, cols)
    result: dict[str, float | None] = {}
    # state per column index: (lo, hi, rank_lo, rank_hi) with 0-based ranks
    # counted from the first value >= lo
    state: dict[int, tuple[float, float, int, int]] = {}
    for i, c in enumerate(cols):
        n, lo, hi = stats[c]
        if not n:
            result[c] = None
        elif lo == hi:
            result[c] = float(lo)
        else:
            state[i] = (lo, hi, (n - 1) // 2, n // 2)
    counts = {i: stats[cols[i]][0] for i in state}
    while state:
        final = {i: s for i, s in state.items() if counts[i] <= final_rows}
        refine = {i: s for i, s in state.items() if i not in final}
        if final:
            rows = (_long_values(df, cols, {i: (s[0], s[1]) for i, s in final.items()})
                    .groupBy("i", "v").count().collect())          # <= final_rows per column
            by_col: dict[int, list] = {}
            for r in rows:
                by_col.setdefault(r["i"], []).append((r["v"], r["count"]))
            for i, (_, _, k1, k2) in final.items():
                vals = sorted(by_col.get(i, []))
                result[cols[i]] = (_value_at(vals, k1) + _value_at(vals, k2)) / 2.0
                del state[i]
        if refine:
            ranges = {i: (s[0], s[1]) for i, s in refine.items()}
            long = _long_values(df, cols, ranges)
            lo_map = F.create_map(*[x for i, (lo, _) in ranges.items() for x in (F.lit(i), F.lit(lo))])
            w_map = F.create_map(*[x for i, (lo, hi) in ranges.items()
                                   for x in (F.lit(i), F.lit((hi - lo) / n_bins))])
            b = F.least(F.lit(n_bins - 1),
                        F.floor((F.col("v") - lo_map[F.col("i")]) / w_map[F.col("i")]).cast("int"))
            bins = (long.withColumn("b", b).groupBy("i", "b")
                        .agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
                        .collect())                                 # <= columns x n_bins rows
            per: dict[int, list] = {}
            for r in bins:
                per.setdefault(r["i"], []).append((r["b"], r["n"], r["mn"], r["mx"]))
            for i, (_, _, k1, k2) in refine.items():
                hist = sorted(per[i])
                before = 0
                pick1 = pick2 = None
                for bi, n, mn, mx in hist:
                    if pick1 is None and k1 < before + n:
                        pick1 = (before, n, mn, mx)
                    if pick2 is None and k2 < before + n:
                        pick2 = (before, n, mn, mx)
                    before += n
                if pick1 is not pick2 and pick1 != pick2:
                    # the two middle ranks sit in different bins: k1 is the
                    # last value of its bin and k2 the first of the next one
                    result[cols[i]] = (pick1[3] + pick2[2]) / 2.0
                    del state[i]
                    continue
                off, n, mn, mx = pick1
                if mn == mx:
                    result[cols[i]] = float(mn)
                    del state[i]
                    continue
                state[i] = (mn, mx, k1 - off, k2 - off)
                counts[i] = n
    return result


def _value_at(sorted_counts: list, k: int) -> float:
    seen = 0
    for v, n in sorted_counts:
        seen += n
        if k < seen:
            return float(v)
    raise ValueError("rank beyond the values")
