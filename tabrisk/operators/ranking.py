"""Distributed ranks, prefix sums and bottom-k.

Spark's ``row_number()`` / running ``sum()`` over a window with no or few
partition keys runs in one task per key.  With a hot key (a class that holds a
third of the rows, one model's whole score table) that task holds a third of
the data.  The helpers here split every key into ordered buckets:

1. count (or sum) per (key, bucket) -- a partial+final aggregate, tiny output;
2. exclusive running total over the buckets of a key -- a window over the
   tiny table;
3. the same window inside each (key, bucket) plus the bucket's offset.

Step 3 spreads one key over as many tasks as it has buckets.  The bucket must
be monotone in the order (e.g. a prefix of a hash, a quantile bucket of a
score), so offsets add up to the global position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabrisk.session import cut_lineage

# Rows a (key, bucket) window may hold at most at scale: a sort of this size
# fits one task's memory budget; more rows mean more buckets.
ROWS_PER_BUCKET = 1 << 20


def _cols(cs):
    return [F.col(c) if isinstance(c, str) else c for c in cs]


def bucket_offsets(df: DataFrame, keys: Sequence[str], bucket: str,
                   sums: dict[str, Column] | None = None) -> DataFrame:
    """Per (key, bucket): totals and the exclusive running totals of the
    buckets before it.  With ``sums=None`` the total is the row count."""
    sums = sums or {"_n": F.count(F.lit(1))}
    per_bucket = df.groupBy(*keys, bucket).agg(*[v.alias(k) for k, v in sums.items()])
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    out = per_bucket
    for k in sums:
        out = out.withColumn(f"{k}_before", F.coalesce(F.sum(k).over(w), F.lit(0)))
    return out


def bucketed_row_number(df: DataFrame, keys: Sequence[str], bucket: str,
                        order: Sequence, out: str = "rank") -> DataFrame:
    """1-based position of each row inside ``keys`` by ``order``.

    ``bucket`` must be non-decreasing along ``order``.  One shuffle on
    (keys, bucket) instead of one task per key."""
    offs = bucket_offsets(df, keys, bucket).select(*keys, bucket, F.col("_n_before").alias("_off"))
    w = Window.partitionBy(*keys, bucket).orderBy(*_cols(order))
    return (df.join(offs, [*keys, bucket])
              .withColumn(out, F.col("_off") + F.row_number().over(w))
              .drop("_off"))


def bucketed_running_sum(df: DataFrame, keys: Sequence[str], bucket: str,
                         order: Sequence, values: Sequence[str],
                         suffix: str = "_cum") -> DataFrame:
    """Inclusive running sums of ``values`` inside ``keys`` by ``order``
    (ties by order must not exist: run it on distinct order values)."""
    sums = {f"_s_{v}": F.sum(v) for v in values}
    offs = bucket_offsets(df, keys, bucket, sums).select(
        *keys, bucket, *[F.col(f"_s_{v}_before").alias(f"_o_{v}") for v in values])
    w = (Window.partitionBy(*keys, bucket).orderBy(*_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = df.join(offs, [*keys, bucket])
    for v in values:
        out = out.withColumn(v + suffix, F.col(f"_o_{v}") + F.sum(v).over(w))
    return out.drop(*[f"_o_{v}" for v in values])


def quantile_bucket(df: DataFrame, keys: Sequence[str], value: str,
                    n_buckets: int = 256, out: str = "_qb",
                    accuracy: int = 10000) -> DataFrame:
    """Monotone bucket of ``value`` per key from approximate quantiles.

    ``percentile_approx`` is a mergeable sketch, so the boundaries cost one
    partial+final aggregate of bounded size.  Boundaries need only be roughly
    balanced: exactness comes from the offsets, not from the bucket."""
    probs = [i / n_buckets for i in range(1, n_buckets)]
    drop = []
    if not keys:
        df, keys, drop = df.withColumn("_k0", F.lit(0)), ["_k0"], ["_k0"]
    bounds = df.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.percentile_approx(value, probs, accuracy))).alias("_bounds"))
    # binary search, a step at a time: the number of bounds below the value
    v, low = F.col(value), F.lit(0)
    step = 1 << max(0, (n_buckets - 1).bit_length() - 1)
    joined = df.join(bounds, list(keys)).withColumn(out, low)
    while step:
        at = F.col(out) + step
        joined = joined.withColumn(out, F.when((at <= F.size("_bounds")) & (F.get("_bounds", at - 1) < v), at).otherwise(F.col(out)))
        step //= 2
    return joined.drop("_bounds", *drop)


def bottom_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int,
             salt_by: Sequence[str], salts: int = 32, out: str = "rank") -> DataFrame:
    """The k first rows of each key by ``order`` (``order`` unique in a key).

    First a top-k inside (key, salt) spreads a hot key over ``salts`` tasks,
    then a top-k over the at most k * salts survivors per key.  ``salt_by``
    are plain columns that identify a row inside its key."""
    order = _cols(order)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    w1 = Window.partitionBy(*keys, "_salt").orderBy(*order)
    first = salted.withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= k)
    w2 = Window.partitionBy(*keys).orderBy(*order)
    return (first.drop("_r1", "_salt")
                 .withColumn(out, F.row_number().over(w2))
                 .where(F.col(out) <= k))


def placed(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows in partitions by ``order`` with ``_part`` and ``_row``, the
    partition's number and the row's 0-based place in it; one row per partition
    with the rows before it, ``_off``).

    Spark samples splitters of (order, a hash of the row), so ranges hold about
    equal numbers of rows whatever the keys are: far-off keys, texts, and ties,
    which the hash spreads over several ranges.  The laid-out rows are
    checkpointed: places are read from one run of the sort."""
    spread = [F.xxhash64(*df.columns)]
    keys = [F.col(c) for c in order]
    laid = df.repartitionByRange(partitions, *keys, *spread) if partitions else df.repartitionByRange(*keys, *spread)
    laid = laid.sortWithinPartitions(*keys, *spread).withColumn("_id", F.monotonically_increasing_id())
    # an id has the partition's number above 33 bits of the row's place
    rows = cut_lineage(laid.select("*", F.shiftright("_id", 33).cast("int").alias("_part"),
                                   F.col("_id").bitwiseAND((1 << 33) - 1).alias("_row")).drop("_id"))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)                  # one row per partition
    return rows, sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))


def position_by_key(df: DataFrame, key: str, out: str = "position", target_buckets: int | None = None) -> DataFrame:
    """1-based position of each row in ``key`` order over the whole table (W1
    for keyed tables), for keys of any type that sorts; rows of equal keys
    follow each other in an order of their own.  A null key is an error.
    ``target_buckets``: the number of partitions, else the session's."""
    rows, offsets = placed(df, [key], target_buckets)
    empty = rows.where(F.col(key).isNull()).count()
    if empty:
        raise ValueError(f"{key}: {empty} rows have no key, so no position")
    return rows.join(offsets, "_part").withColumn(out, F.col("_off") + F.col("_row") + 1).drop("_part", "_row", "_off")
