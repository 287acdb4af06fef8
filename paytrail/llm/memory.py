"""Memory of Python workers: bounded batches, and what a task held goes back to the system."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20  # of rows sent to a worker at a time; Spark's own limit is 64 MB
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"

Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: What empties a module's tables when a task ends.
AT_END: list[Callable[[], None]] = []


def give_back() -> None:
    """Returns what a task has freed to the system: Python workers live on, and other stages need the memory."""
    for empty in AT_END:
        empty()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_texts(rows: DataFrame, run: Run, schema: str | StructType) -> DataFrame:
    """``rows.mapInArrow``, for rows that hold whole texts: a worker gives its memory back when its task ends, and gets some ``BATCH_BYTES`` at a time.

    Without that limit a batch has 10 000 rows whatever their length, and both the executor and the worker hold it whole. It is the session's
    setting, since a result is computed later; a session that has a limit of its own keeps that.
    """
    conf = rows.sparkSession.conf
    if conf.get(_LIMIT, None) is None:
        conf.set(_LIMIT, str(BATCH_BYTES))

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(freed, schema)
