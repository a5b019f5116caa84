"""Publish and subscribe as a stream-static join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.globs import matches


def deliveries(messages: DataFrame, exact: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """Each streamed message (channel, ...) to each taker: an equi-join with the (session, channel)
    table, and the (session, pattern) list tested on the message's channel. The list is part of
    the plan, so it is meant for hundreds of patterns; the table may be of any size."""
    by_name = messages.join(exact, "channel").withColumn("pattern", F.lit(None).cast("string"))
    if not patterns:
        return by_name
    tests = F.array(*[F.when(matches(F.col("channel"), p), F.struct(F.lit(s).alias("session"), F.lit(p).alias("pattern"))) for s, p in patterns])
    hits = messages.withColumn("_t", F.explode(F.filter(tests, lambda t: t.isNotNull())))
    by_pattern = hits.select(*messages.columns, "_t.session", "_t.pattern")
    return reduce(DataFrame.union, [by_name.select(*messages.columns, "session", "pattern"), by_pattern])
