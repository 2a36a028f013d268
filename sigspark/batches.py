"""Arrow batches of bounded size, and Python processes that don't keep what they used."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession


def bounded_batches(spark: SparkSession, rows: int = 2000, size: int = 4 << 20) -> None:
    """Let no Arrow batch of this session have more than ``rows`` rows or many more than ``size`` bytes.

    Whole texts and signals are long, and JVM and Python each hold batches. A row of more bytes is a batch of its own.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key).rstrip("b")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(key, most)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, whose process gives freed memory back to the system when a task ends.

    Processes are used again by later tasks and stages; what their allocators keep would add up over a session.
    """

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return trim


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc; other libraries have none
    if trim is not None:
        trim(0)
