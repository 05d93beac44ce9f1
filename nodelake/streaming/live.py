"""Latest events of a live stream: the batch rule (last delivery wins) under a watermark.

Beyond the batch operator: a correction that comes later than ``delay`` after the newest event is lost
here, where the batch form would still use it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: Sequence[str], time: str, values: Sequence[str], *, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Of the events with equal keys in a window, the last by time; works on streams and on tables."""
    timed = events.withWatermark(time, delay).groupBy(F.window(time, window), *keys)
    last = timed.agg(F.max_by(F.struct(*[v for v in values if v != time]), F.struct(time, *[v for v in values if v != time])).alias("last"), F.max(time).alias(time))
    return last.select(F.col("window.start").alias("window_start"), *keys, time, "last.*")


def counts(events: DataFrame, keys: Sequence[str], time: str, *, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Events of each key in tumbling windows."""
    timed = events.withWatermark(time, delay).groupBy(F.window(time, window), *keys)
    return timed.agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")
