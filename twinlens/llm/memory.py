"""Memory of Python workers, which Spark keeps for later tasks, and of what is sent to them."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of an Arrow batch of whole texts (one row at least), and Spark's setting for them.
BATCH, _BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Send workers batches of ``BATCH`` bytes, unless the session has a size of its own.

    Spark's default of 64 MB is held in the executor and in the worker by each
    task at once. The setting is read when a plan is run, so it stays.
    """
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH))


def give_back() -> None:
    """At the end of a task: return what is free to the system, for whatever the executor runs next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        return
