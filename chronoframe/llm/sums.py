"""Fixed-size float64 vectors summed over partitions in two levels."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def tree_sum(parts: DataFrame, size: int, kind: type = np.float64) -> np.ndarray:
    """Sum of the ``part`` column (binary, ``size`` numbers of ``kind`` each).

    Each of about sqrt(partitions) tasks streams its share into one vector and the driver adds those,
    so no task and no result grows faster than the square root of the input. The driver reads task after
    task, a job each, so they are dealt without a key: their number is never raised to the shuffle partitions.
    """
    n = max(1, math.isqrt(parts.rdd.getNumPartitions()))

    def add(batches):
        total, any_row = np.zeros(size), False
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), kind, size)
                any_row = True
        if any_row:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype(kind).tobytes()], pa.binary())], names=["part"])

    total = np.zeros(size)
    spread = parts.select("part").repartition(n)
    for r in spread.mapInArrow(add, "part binary").toLocalIterator(prefetchPartitions=True):
        total += np.frombuffer(r["part"], kind, size)
    return total


def part_batch(total: np.ndarray) -> pa.RecordBatch:
    """One partition's share, for ``tree_sum``."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(total, np.float64).tobytes()], pa.binary())], names=["part"])
