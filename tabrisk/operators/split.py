"""E1 stratified train/test split and E2 stratified folds.

Order inside a class is md5('seed-key') (then tie-break columns); the test
share of each class is fixed by largest remainder; the first ``quota`` rows of
a class in hash order are the test rows.  The same rule is one window in SQL,
so every split here can be checked against DuckDB.

Scale: a class may hold a third of all rows, so no step ranks a whole class in
one task.  The split ranks only the rows of the one hash bucket (a hash prefix sized by
bucket_digits)
where a class's quota ends; the folds use bucket offsets (ranking.py).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.contract import N_FOLDS, RANDOM_STATE, TEST_PERCENT
from tabrisk.functions.expressions import hash_key
from tabrisk.operators.ranking import ROWS_PER_BUCKET, bucketed_row_number
from tabrisk.session import small_side

MIN_DIGITS, MAX_DIGITS = 2, 8


def class_quotas(class_counts: DataFrame, label: str, n_col: str = "n_class",
                 test_percent: int = TEST_PERCENT) -> DataFrame:
    """Test rows per class: n_test = ceil(n * pct / 100) split over classes by
    largest remainder (ties to the smaller label).  Integer arithmetic in
    decimal(38,0), so it is exact for any table size.  Input: one row per class."""
    d = "decimal(38,0)"
    tot = Window.partitionBy()
    n = F.sum(F.col(n_col)).over(tot).cast(d)
    n_test = F.floor((n * test_percent + 99) / 100).cast(d)
    prod = (n_test * F.col(n_col).cast(d))
    q = (class_counts
         .withColumn("_n", n).withColumn("_n_test", n_test)
         .withColumn("_base", F.floor(prod / F.col("_n")).cast("long"))
         .withColumn("_rem", F.pmod(prod, F.col("_n")))
         .withColumn("_left", (F.col("_n_test") - F.sum("_base").over(tot)).cast("long"))
         .withColumn("_order", F.row_number().over(
             Window.orderBy(F.col("_rem").desc(), F.col(label))))
         .withColumn("quota", F.col("_base") + F.when(F.col("_order") <= F.col("_left"), 1).otherwise(0)))
    return q.select(label, n_col, "quota")


def quota_table(counts: dict, test_percent: int = TEST_PERCENT) -> dict:
    """The same largest-remainder rule on the driver for a {class: count}
    dict (one entry per class, so bounded): exact Python integers."""
    n = sum(counts.values())
    n_test = (n * test_percent + 99) // 100
    if n == 0:
        return {c: 0 for c in counts}
    base = {c: (n_test * k) // n for c, k in counts.items()}
    rem = {c: (n_test * k) % n for c, k in counts.items()}
    left = n_test - sum(base.values())
    order = sorted(counts, key=lambda c: (-rem[c], c))
    return {c: base[c] + (1 if i < left else 0) for i, c in enumerate(order)}


def bucket_digits(largest_class: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits of the hash prefix used as the bucket: enough that a bucket
    of the largest class holds about ``rows_per_bucket`` rows (16^d buckets),
    at least 256 buckets per class for parallelism.  Any prefix length keeps
    the md5 order, so the result does not depend on it."""
    d = MIN_DIGITS
    while d < MAX_DIGITS and largest_class > rows_per_bucket * 16 ** d:
        d += 1
    return d


def _hashed(df: DataFrame, key_cols: Sequence[str], seed: int) -> DataFrame:
    return df.withColumn("_h", hash_key(seed, *key_cols))


def _class_counts(base: DataFrame, label: str) -> dict:
    """Rows per class: one partial+final aggregate, one row per class."""
    counts = {r[0]: r[1] for r in base.groupBy(label).agg(F.count(F.lit(1))).collect()}
    if None in counts:
        raise ValueError(f"{label}: {counts[None]} rows have no label; a split by class needs one for each row")
    return counts


def _with_bucket(base: DataFrame, counts: dict) -> DataFrame:
    digits = bucket_digits(max(counts.values(), default=0))
    return base.withColumn("_b", F.substring("_h", 1, digits))


#: Hex digits of the first bucket counts.
COUNT_DIGITS = 3


def _cut_buckets(base: DataFrame, label: str, test_percent: int, rows_per_bucket: int) -> dict:
    """{class: (hash prefix of the bucket where its quota ends, rows of the
    quota inside it)}, for classes with a quota.  Class sizes and buckets come
    from one aggregate; a bucket that is too large to rank is counted again by
    more digits."""
    digits = COUNT_DIGITS
    per_bucket = base.groupBy(label, F.substring("_h", 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r[0]: r["n"] for r in per_bucket.groupBy(label).agg(F.sum("n").alias("n")).collect()}      # one row per class
    if None in sizes:
        per_bucket.unpersist()
        raise ValueError(f"{label}: {sizes[None]} rows have no label; a split by class needs one for each row")
    need = {c: q for c, q in quota_table(sizes, test_percent).items() if q}
    cut = {}
    while need:
        want = F.create_map(*[F.lit(x) for pair in need.items() for x in pair])[F.col(label)]
        w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)           # at most 16^digits rows a class
        rows = (per_bucket.where(F.col(label).isin(list(need))).withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0)))
                .where((F.col("_before") < want) & (want <= F.col("_before") + F.col("n"))).collect())
        per_bucket.unpersist()
        large = {}
        for r in rows:
            cut[r[label]] = (r["_b"], need[r[label]] - r["_before"])
            if r["n"] > rows_per_bucket and digits < MAX_DIGITS:
                large[r[label]] = need[r[label]] - r["_before"]
        need, digits = large, digits + 2
        if need:
            inside = [(F.col(label) == c) & F.col("_h").startswith(cut[c][0]) for c in need]
            per_bucket = (base.where(reduce(or_, inside)).groupBy(label, F.substring("_h", 1, digits).alias("_b"))
                              .agg(F.count(F.lit(1)).alias("n")).persist(StorageLevel.MEMORY_AND_DISK))
    return cut


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str],
                     tiebreak: Sequence[str] = (), test_percent: int = TEST_PERCENT,
                     seed: int = RANDOM_STATE, out: str = "split", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Adds ``out`` = 'test' / 'train' (E1).

    One aggregate of (class, bucket) counts tells per class the bucket where
    its quota ends; the rows of that bucket are ranked once to find the last
    test row.  The split itself is a column expression, a comparison with that
    row, so whatever reads it later scans the input once.  Only where rows
    equal in hash and tie-break stand on both sides of the quota are they
    ranked in the result."""
    order = ["_h", *tiebreak]
    base = _hashed(df, key_cols, seed)
    cut = _cut_buckets(base, label, test_percent, rows_per_bucket)
    if not cut:
        return df.withColumn(out, F.lit("train"))
    inside = reduce(or_, [(F.col(label) == c) & F.col("_h").startswith(b) for c, (b, _) in cut.items()])
    wanted = F.create_map(*[F.lit(x) for c, (_, n) in cut.items() for x in (c, n)])[F.col(label)]
    ranked = base.where(inside).select(label, *order)
    by_order = Window.partitionBy(label).orderBy(*order)
    same = Window.partitionBy(label, *order)
    last = (ranked.withColumn("_r", F.row_number().over(by_order)).withColumn("_first", F.min("_r").over(same))
                  .withColumn("_n", F.count(F.lit(1)).over(same)).where(F.col("_r") == wanted).collect())  # one row per class
    key = F.struct(*[F.col(c) for c in order])
    types = [base.schema[c].dataType for c in order]
    expr, parted = F.lit(False), []
    for r in last:
        own, edge = F.col(label) == r[label], F.struct(*[F.lit(r[c]).cast(t).alias(c) for c, t in zip(order, types)])
        whole = r["_first"] + r["_n"] - 1 == r["_r"]
        if not whole:
            parted.append((own & (key == edge), r["_r"] - r["_first"] + 1))
        expr = expr | (own & ((key <= edge) if whole else (key < edge)))
    if not parted:
        return base.withColumn(out, F.when(expr, F.lit("test")).otherwise(F.lit("train"))).drop("_h")
    tied = reduce(or_, [F.coalesce(c, F.lit(False)) for c, _ in parted])
    decided = base.where(~tied).withColumn(out, F.when(expr, F.lit("test")).otherwise(F.lit("train")))
    take = reduce(lambda a, x: a.when(x[0], F.lit(x[1])), parted[1:], F.when(parted[0][0], F.lit(parted[0][1])))
    some = (base.where(tied).withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(*order)))
                .withColumn(out, F.when(F.col("_r") <= take, F.lit("test")).otherwise(F.lit("train"))).drop("_r"))
    return decided.unionByName(some).drop("_h")


def split_and_folds(df: DataFrame, label: str, key_cols: Sequence[str],
                    tiebreak: Sequence[str] = (), test_percent: int = TEST_PERCENT,
                    n_folds: int = N_FOLDS, seed: int = RANDOM_STATE) -> DataFrame:
    """Adds ``split`` and ``fold`` (E1 + E2): the same hash order as
    ``stratified_split``; train rows are dealt round-robin to ``n_folds``
    folds in that order, so each fold keeps the class shares.  Test rows get
    fold null.  One shuffle on (class, hash bucket)."""
    base = _hashed(df, key_cols, seed)
    counts = _class_counts(base, label)
    base = _with_bucket(base, counts)
    # exact integer quotas on the driver, one row per class
    rows = list(quota_table(counts, test_percent).items())
    quotas = df.sparkSession.createDataFrame(
        rows, base.select(label).schema.add("quota", "long"))
    ranked = bucketed_row_number(base, [label], "_b", ["_h", *tiebreak], out="_rank")
    return (ranked.join(small_side(quotas, len(rows)), label)
                  .withColumn("split", F.when(F.col("_rank") <= F.col("quota"), F.lit("test"))
                              .otherwise(F.lit("train")))
                  .withColumn("fold", F.when(F.col("split") == "train",
                                             F.pmod(F.col("_rank") - F.col("quota") - 1,
                                                    F.lit(n_folds)).cast("int")))
                  .drop("_h", "_b", "_rank", "quota"))
