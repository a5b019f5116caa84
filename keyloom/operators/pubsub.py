"""Publish and subscribe, as a batch: messages (channel, ...) and subscriptions of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.globs import matches


def pattern_channels(channels: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(session, pattern, channel): which channels each (session, pattern) takes in. Patterns are
    tested once for each distinct channel, not for each message."""
    tests = F.array(*[F.when(matches(F.col("channel"), p), F.struct(F.lit(s).alias("session"), F.lit(p).alias("pattern"))) for s, p in patterns])
    hits = channels.select("channel").distinct().select("channel", F.explode(F.filter(tests, lambda t: t.isNotNull())).alias("_t"))
    return hits.select("_t.session", "_t.pattern", "channel")


def fanout(messages: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """One row for each delivery: a session that takes a channel by name and by pattern gets two."""
    takers = exact.select("session", F.lit(None).cast("string").alias("pattern"), "channel")
    if patterns:
        takers = takers.union(pattern_channels(messages, patterns))
    return messages.join(takers, "channel")


def numsub(exact: DataFrame) -> DataFrame:
    return exact.groupBy("channel").agg(F.count_distinct("session").alias("n"))


def channels(exact: DataFrame, pattern: str = "*") -> DataFrame:
    return exact.where(matches(F.col("channel"), pattern)).select("channel").distinct()


def numpat(patterns: DataFrame) -> DataFrame:
    return patterns.agg(F.count_distinct("pattern").alias("n"))
