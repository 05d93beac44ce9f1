"""Adding up arrays of a fixed size over partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that one task adds up, at most.
FAN = 64


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """The sum over partitions of ``partial(batches)``, a float64 array of ``size`` numbers.

    Each partition gives one array; FAN neighbours are added on the executors, and FAN of these sums again,
    so no task holds more than two arrays at a time or reads more than FAN, and the driver gets one for 4,096
    partitions.
    """

    def each(batches):
        total = partial(batches)
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.astype("<f8").tobytes()], pa.binary())], ["slot", "total"])

    def add(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(size)
        for x in rows.column("total"):
            total += np.frombuffer(x.as_buffer(), "<f8")
        return pa.table({"slot": pa.array([key[0].as_py()], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "slot long, total binary"
    sums = rows.mapInArrow(each, schema)
    for _ in range(2):
        sums = sums.select(F.floor(F.col("slot") / F.lit(FAN)).alias("slot"), "total").groupBy("slot").applyInArrow(add, schema)
    return sum((np.frombuffer(r["total"], "<f8") for r in sums.select("total").collect()), np.zeros(size))
