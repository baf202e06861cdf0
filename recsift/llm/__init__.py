"""Operators of a training-data pipeline over the tables documents, pages, benchmark and labels."""

import ctypes
import gc

import pyarrow as pa

from recsift.session import ensure_checkpoint_dir

#: rows of one Arrow batch; whole texts may be long, and a worker holds a few copies of a batch
ARROW_ROWS = 1000
#: bytes of one Arrow batch, at most (but for a single larger row)
ARROW_BYTES = 4 << 20


def bounded_batches(spark) -> None:
    """Keep Arrow batches of texts small enough for a Python worker's memory; workers get the package."""
    ensure_checkpoint_dir(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def release_memory() -> None:
    """Hand a worker's freed memory back to the system, Arrow's and, where it can, the C library's; workers outlive their stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass
