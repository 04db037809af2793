"""Bounds for what a Python worker holds: the batches sent to it, and the steps that it cuts them into."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of a batch of rows sent to a Python worker (one row at least), where the session sets no bound of its own.
BATCH_BYTES = 4 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a batch's rows that one step works on; a larger row makes a step of its own.
STEP_BYTES = 1 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the batches that executors and their workers hold twice each, unless the session was given a bound."""
    if BATCH_CONF not in spark.conf.getAll:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))


def steps(batch: pa.RecordBatch, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch's rows in order, halved until a part takes at most limit bytes or is one row."""
    if batch.num_rows > 1 and batch.nbytes > limit:
        half = batch.num_rows // 2
        yield from steps(batch.slice(0, half), limit)
        yield from steps(batch.slice(half), limit)
    elif batch.num_rows:
        yield batch


def give_back() -> None:
    """The worker's free memory to the machine: the next task may run in another worker."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):  # another C library keeps its own counsel
        return lambda _: 0
