"""Last writes and counters of a stream of commands, kept as snapshots on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_counts(events: DataFrame, *, delay: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Writes of each key in tumbling windows of event time ``ts``, late ones within ``delay``."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "key").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def expired(batch: DataFrame, now: int) -> DataFrame:
    """The keys of a micro-batch whose deadline has passed, for a sweep in ``foreachBatch``."""
    return batch.where(F.col("expire_at") <= now).select("key")
