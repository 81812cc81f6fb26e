"""Tables in the shared folder, pair cells for hot groups, and components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabrisk.session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table, with the named columns only."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    is cut there, so a lost executor costs no recomputation, and the planner
    knows the real size."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like ``wanted`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def labelled_sample(rows: DataFrame, known: DataFrame, max_rows: int) -> DataFrame:
    """About ``max_rows`` rows of ``rows`` (id, ...) that ``known`` (id, y; one
    row an id) labels, with y and a hash ``content`` of their other columns.

    Labels of absent ids don't count.  Ids are chosen by their hash; where few
    ids have many rows, rows are chosen by their content, so the bound is on
    distinct rows.  Only ids and counts are joined before rows are chosen."""
    part = lambda c: F.pmod(c, F.lit(1 << 20))
    there = written(rows.select("id").groupBy("id").count().join(known, "id"), "labelled-ids")
    chosen = there.where(part(F.xxhash64("id")) < int(min(1.0, max_rows / max(1, there.count())) * (1 << 20)))
    n_rows = chosen.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    # about max_rows ids: small enough to broadcast
    out = rows.join(F.broadcast(chosen.select("id", "y")), "id")
    other = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c != "id"]
    out = out.where(part(F.xxhash64("id", *other, F.lit("row"))) < int(min(1.0, max_rows / max(1, n_rows)) * (1 << 20)))
    return out.withColumn("content", F.xxhash64(*other))


def pair_cells(df: DataFrame, keys: list[str], spread: str, limit: int) -> DataFrame:
    """Split groups of ``keys`` that hold over ``limit`` rows into cells.

    A group of n rows has s = ceil(n / limit) chunks (by a hash of ``spread``)
    and one cell for each unordered pair of chunks, so that any two rows of a
    group meet in a cell and no cell holds much over 2 * limit rows.  Adds
    ``cell_a`` <= ``cell_b`` and ``side`` (0 or 1: the row's chunk); in a cell
    of two chunks only pairs of unequal sides are to be compared, so each pair
    is seen once.  Smaller groups have the single cell (0, 0).
    """
    hot = (df.groupBy(*keys).count().where(F.col("count") > limit)
             .select(*[F.col(k).alias(f"_hot_{k}") for k in keys],
                     F.ceil(F.col("count") / limit).cast("int").alias("_chunks")))
    # written first, so that the planner knows its size and moves no row of df for a small one
    hot = written(hot, "hot-groups")
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    chunks = F.coalesce("_chunks", F.lit(1))
    return (df.join(hot, same, "left")
              .withColumn("_own", F.pmod(F.xxhash64(spread), chunks).cast("int"))
              .withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
              .withColumn("cell_a", F.least("_own", "_other"))
              .withColumn("cell_b", F.greatest("_own", "_other"))
              .withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
              .drop("_own", "_other", "_chunks", *[f"_hot_{k}" for k in keys]))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): one row (node, root) for
    each node of an edge, where root is the smallest node of its component.

    Each round points every node at its smallest neighbour, follows these
    pointers a few times and contracts the edges to what is left, so rounds
    grow with the logarithm of the longest chain.  Every step is a shuffle of
    a written table: aggregates combine before the shuffle, and joins are
    plain ones whose hot keys AQE can split.  Nothing reaches the driver but
    the number of edges left.
    """
    def ordered(df):
        return (df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                  .where("a < b").distinct())

    edges = written(ordered(edges), "edges")
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy(F.col("a").alias("node"))
                         .agg(F.min("b").alias("_b"))
                         .select("node", F.least("node", "_b").alias("root")), "pointers")
        for _ in range(2):
            hop = up.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            up = written(up.join(hop, "root").select("node", F.col("_next").alias("root")), "pointers")
        steps.append(up)
        left = edges.join(up.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a")
        left = left.join(up.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b")
        edges = written(ordered(left.select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = steps[0]
    for step in steps[1:]:
        step = step.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        out = out.join(step, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
    return written(out, "components")
