"""Helpers for code that runs inside Python workers, and for their input."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch: what a worker holds at once, besides one row.
BATCH_ROWS = 2000
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Have Spark cut Arrow batches by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def worker_state(name: str, key: Any, make: Callable[[], Any]) -> Any:
    """What ``make`` built for ``(name, key)`` in this worker process.

    A worker serves many tasks; only the latest state is kept, so that a worker
    never holds the tables of an operator that ended.
    """
    home = sys.modules.setdefault("_callsieve_worker", types.ModuleType("_callsieve_worker"))
    if getattr(home, "key", None) != (name, key):
        home.state = None
        home.state = make()
        home.key = (name, key)
    return home.state


def give_back() -> None:
    """Return freed memory to the machine: idle workers stay, and their pools would keep it."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def map_arrow(
    df: DataFrame, step: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``step`` to each Arrow batch of ``df``."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = step(batch)
                if out is not None and out.num_rows:
                    yield out
        batch = out = None
        give_back()

    return df.mapInArrow(run, schema)
