"""Equi-joins whose larger side may pile up on a few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hot keys there may be at most, whatever the session's number of shuffle partitions.
MAX_HOT = 8000


def hot_keys(counts: DataFrame, keys: list[str], most: int | None = None) -> DataFrame:
    """(keys, _parts) of the hot keys of a stored table of counts (keys, n): those with more rows than
    two even tasks would have, and how many such parts they fill. That is at most ``most`` rows, by
    default half the shuffle partitions, so they may be broadcast whatever the input."""
    most = most or max(2, min(MAX_HOT, int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 2))
    share = (counts.agg(F.sum("n").alias("n")).first()["n"] or 0) // most + 1
    return counts.where(F.col("n") > share).select(*keys, F.ceil(F.col("n") / share).cast("int").alias("_parts"))


def _dealt(big: DataFrame, keys: list[str], hot: DataFrame, by: list[str]) -> DataFrame:
    marked = big.join(F.broadcast(hot), keys, "left")
    return marked.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_parts")), F.lit(0)).cast("int")).drop("_parts")


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, *, by: list[str], how: str = "inner") -> DataFrame:
    """The equi-join of ``big`` with ``small``: the rows of a hot key are dealt to its parts by a hash
    of the columns ``by``, and the rows of ``small`` go to each. No part has much more than its share."""
    cold = small.join(F.broadcast(hot), keys, "left_anti").withColumn("_salt", F.lit(0))
    every = small.join(F.broadcast(hot), keys).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    return _dealt(big, keys, hot, by).join(cold.unionByName(every), [*keys, "_salt"], how).drop("_salt")
