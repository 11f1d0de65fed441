"""Sums of long vectors over all partitions: each task adds up its own rows, 64 tasks add those, the driver the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

SLOTS = 64


def partition_sum(df: DataFrame, size: int, add: Callable[[pa.RecordBatch, np.ndarray], None], combine: Callable = np.add, start: float = 0.0) -> np.ndarray:
    """``add(batch, total)`` adds a batch into a float64 vector of ``size``; returns the vector over all of ``df``.

    ``combine`` and its neutral element ``start`` may be another reduction than addition.
    """

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.full(size, start)
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                add(batch, total)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % SLOTS]), pa.array([total.tobytes()], pa.binary())], names=["slot", "v"])

    def merge(batch: pa.Table) -> pa.Table:
        total = np.full(size, start)
        for v in batch.column("v"):
            total = combine(total, np.frombuffer(v.as_py()))
        return pa.table({"v": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(kernel, "slot long, v binary").groupBy("slot").applyInArrow(merge, "v binary").collect()
    total = np.full(size, start)
    for r in rows:
        total = combine(total, np.frombuffer(bytes(r.v)))
    return total
