"""Range indexes: rows (k, v) in byte order of k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(df: DataFrame, path: str, partitions: int | None = None) -> DataFrame:
    """Written in ranges of k and sorted within files, so that scans skip files and row groups: the
    stored index. Without ``partitions`` their number follows from the data."""
    dealt = df.repartitionByRange(partitions, "k") if partitions else df.repartitionByRange("k")
    dealt.sortWithinPartitions("k").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def riexists(indexes: DataFrame, request: DataFrame) -> DataFrame:
    """(idx, found) of each request (idx) among the rows (idx, ...) of all indexes."""
    held = indexes.select("idx").distinct().withColumn("_in", F.lit(1))
    return request.join(held, "idx", "left").select("idx", F.coalesce("_in", F.lit(0)).alias("found"))


def rimetrics(index: DataFrame) -> DataFrame:
    """One row: entries, bytes of keys and values, the first and the last key."""
    size = lambda c: F.coalesce(F.sum(F.octet_length(F.col(c).cast("string"))), F.lit(0)).alias(f"{c}_bytes")
    return index.agg(F.count(F.lit(1)).alias("n"), size("k"), size("v"), F.min("k").alias("first"), F.max("k").alias("last"))


def riset(index: DataFrame, new: DataFrame) -> DataFrame:
    return index.join(new.select("k"), "k", "left_anti").union(new.select("k", "v"))


def ridel(index: DataFrame, keys: DataFrame) -> DataFrame:
    return index.join(keys.select("k"), "k", "left_anti")


def riget(index: DataFrame, keys: DataFrame) -> DataFrame:
    return keys.select("k").join(index, "k", "left")


def riscan(index: DataFrame, start: str, count: int) -> DataFrame:
    if count < 1:
        raise ValueError("count must be 1 or more")
    return index.where(F.col("k") >= start).orderBy("k").limit(count)


def rirange(index: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends included."""
    return index.where(F.col("k").between(start, end))
