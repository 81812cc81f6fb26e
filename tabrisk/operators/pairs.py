"""Blocks of query rows against all blocks of training rows, with no row of
either copied for a pair.

Rows are packed into blocks, one row of Arrow bytes each (``pack``).  A task of
``all_pairs`` has the query blocks of one partition and reads the training
blocks, one at a time, from where they were checkpointed: a join of pairs would
write every training block once for each query block that it meets, which grows
with the product of both.  What is written grows with the rows alone.

A task holds a query block with its state and one training block.  With few
query blocks the training blocks are read in several slices, so that all cores
have work; then each query block has a result for each slice.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no install

#: Tasks wanted for each core.
TASKS_PER_CORE = 3


def to_bytes(table) -> bytes:
    import pyarrow as pa
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(data):
    import pyarrow as pa
    return pa.ipc.open_stream(pa.py_buffer(bytes(data))).read_all().combine_chunks()


def pack(rows: DataFrame, within: list[str], most: int, largest: str | None = None) -> DataFrame:
    """Rows that follow each other in a partition with the same ``within``
    (long), ``most`` at most, as one row: ``within``, the block's number in its
    partition, its rows, the largest value of ``largest``, and ``_block``."""
    def run(batches):
        import pyarrow as pa
        held, at, n, number = [], None, 0, 0

        def block():
            table = pa.Table.from_batches(held).combine_chunks()
            top = max(table[largest].to_pylist()) if largest else 0.0
            return pa.RecordBatch.from_arrays(
                [*[pa.array([v], pa.int64()) for v in (*at, number, n)], pa.array([top], pa.float64()),
                 pa.array([to_bytes(table)], pa.binary())], [*within, "_number", "_n", "_largest", "_block"])

        for rb in batches:
            if not rb.num_rows:
                continue
            keys = np.column_stack([rb.column(c).to_numpy(zero_copy_only=False) for c in within])
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1), len(keys)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                while i < j:
                    if held and (n == most or at != tuple(keys[i])):
                        yield block()
                        held, n, number = [], 0, number + 1
                    step = min(j - i, most - n)
                    held.append(rb.slice(i, step))
                    at, n, i = tuple(keys[i]), n + step, i + step
        if held:
            yield block()

    return rows.mapInArrow(run, ", ".join([*[f"{c} long" for c in within], "_number long, _n long, _largest double, _block binary"]))


def slices_for(asked: DataFrame, held: DataFrame) -> int:
    """Slices of the training blocks that give all cores work."""
    tasks = TASKS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism
    return max(1, min(held.rdd.getNumPartitions(), -(-tasks // max(1, asked.rdd.getNumPartitions()))))


def all_pairs(asked: DataFrame, held: DataFrame, run: Callable, schema, slices: int) -> DataFrame:
    """The rows (``schema``) of the Arrow tables that ``run`` gives for an
    iterator of (query block, training block).  ``held`` should be checkpointed:
    it is read once for each partition of ``asked``."""
    found = asked.rdd.cartesian(held.coalesce(slices).rdd).mapPartitions(lambda pairs: ((to_bytes(t),) for t in run(pairs)))

    def rows(batches):
        for rb in batches:
            for data in rb.column(0):
                yield from from_bytes(data.as_buffer()).to_batches(max_chunksize=10_000)

    return asked.sparkSession.createDataFrame(found, "_v binary").mapInArrow(rows, schema)
