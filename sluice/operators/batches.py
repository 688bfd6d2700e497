"""Arrow batches of bounded size: what a task holds doesn't follow the number or the length of the rows it goes through."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of an Arrow batch that Spark hands to Python, at most, but for a row that is longer by itself.
BATCH_BYTES = 4 << 20


def shares(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, end) of runs of rows whose sizes come to `most` together at most; a row that is larger is one by itself."""
    ends, start = np.cumsum(sizes), 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        yield start, end
        start = end


def give_back() -> None:
    """Return freed memory to the system: workers live from task to task, and their executors have bounds."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow whose batches are cut by bytes too, and which gives memory back at the end of each task.

    The former is a setting of the session, as what is returned runs later: `spark.sql.execution.arrow.maxBytesPerBatch` becomes `BATCH_BYTES` where it is more.
    """
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > BATCH_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        try:
            yield from f(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
