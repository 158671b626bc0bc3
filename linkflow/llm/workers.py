"""Memory of the Python workers: small Arrow batches, and what a task has freed given back when it ends.

Spark keeps workers from task to task, and their allocators keep what a task has freed, so
without this an executor holds the peaks of all its workers at once, also while they wait.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH_BYTES = 4 << 20          # bytes of an Arrow batch sent to a worker (one larger row stands alone); Spark's default is 64 MB
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Freed memory goes from the allocators back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc has it
    if trim:
        trim(0)


def map_batches(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` in batches of ``BATCH_BYTES``, unless the session sets a limit of its own."""
    conf = df.sparkSession.conf
    if BATCH_LIMIT not in conf.getAll:
        conf.set(BATCH_LIMIT, str(BATCH_BYTES))

    def lean(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(lean, schema)
