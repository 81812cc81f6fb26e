"""Session and scratch-folder helpers.

Library code never creates its own session: every operator takes the caller's
``SparkSession`` (or a DataFrame) so that cluster settings win.  ``local_session``
is for tests, the bench and examples only.
"""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = 8, shuffle_partitions: int | None = None,
                  app: str = "tabrisk") -> SparkSession:
    """A local session with the settings the tests and bench use."""
    if shuffle_partitions is None:
        shuffle_partitions = int(cpus) if str(cpus).isdigit() else 8
    parts = shuffle_partitions
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TABRISK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tabrisk-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the cluster.

    The folder named by ``spark.checkpoint.dir`` (or already set on the
    context) is used as is.  Only a local-mode session without one gets a
    fresh scratch folder; on a cluster a missing setting is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="tabrisk-ckpt-")
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder "
        "(HDFS/S3/ABFS) before running iterative operators")


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint folder (never local)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


@contextmanager
def files_released(spark: SparkSession):
    """Inside, the shuffle files of a query are removed as soon as it has ended
    (else when the driver happens to collect its garbage): for queries one
    after the other whose results are collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_side(df, n_rows: int, limit: int = 100_000):
    """``df`` with a broadcast hint if it has at most ``limit`` rows; a larger
    one is left to the planner (sort-merge, skew split by AQE)."""
    return F.broadcast(df) if n_rows <= limit else df


#: Numbers that a partition of a cached training frame holds at most, about (50 MB of doubles).
PARTITION_VALUES = 6_400_000


def right_size(df, n_rows: int, width: int = 64):
    """Lay a training frame out in partitions of at most about
    ``PARTITION_VALUES`` numbers, for rows of ``width`` numbers each.
    Iterative fits run one job per iteration; with a few hundred rows spread
    over many partitions the task overhead dominates, so they are coalesced.
    Too few partitions are made more, so that what a task holds does not grow
    with the rows or with the features of a row."""
    import math
    target = max(1, math.ceil(n_rows * max(1, width) / PARTITION_VALUES))
    now = df.rdd.getNumPartitions()
    if target < now:
        return df.coalesce(target)
    return df.repartition(target) if target > now else df


def run_parallel(fn, items, parallelism: int = 5):
    """Submit independent Spark jobs from a few driver threads (what
    CrossValidator(parallelism=n) does), e.g. one fit per fold."""
    from concurrent.futures import ThreadPoolExecutor
    items = list(items)
    if len(items) <= 1 or parallelism <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as ex:
        return list(ex.map(fn, items))
