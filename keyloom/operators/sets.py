"""Sets: rows (key, member), each once. Set algebra takes single-key sets of a ``member`` column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.globs import matches
from keyloom.functions.ranges import drawn


def one(s: DataFrame, key) -> DataFrame:
    return s.where(F.col("key") == F.lit(key)).select("member")


def sadd(s: DataFrame, more: DataFrame) -> DataFrame:
    return s.union(more.select("key", "member")).distinct()


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def smismember(s: DataFrame, request: DataFrame) -> DataFrame:
    return request.join(s.withColumn("_in", F.lit(1)), ["key", "member"], "left").withColumn("is_member", F.coalesce("_in", F.lit(0))).drop("_in")


def sinter(sets: list[DataFrame]) -> DataFrame:
    """One pass: members that as many sets hold as there are. A key without members empties it."""
    every = reduce(DataFrame.union, [s.select("member") for s in sets])
    return every.groupBy("member").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(sets)).select("member")


def sunion(sets: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, [s.select("member") for s in sets]).distinct()


def sdiff(first: DataFrame, rest: list[DataFrame]) -> DataFrame:
    return first.select("member").join(reduce(DataFrame.union, [r.select("member") for r in rest]), "member", "left_anti")


def sintercard(sets: list[DataFrame], limit: int = 0) -> DataFrame:
    rows = sinter(sets)
    return (rows.limit(limit) if limit else rows).agg(F.count(F.lit(1)).alias("n"))


def stored(rows: DataFrame, dest, into: DataFrame | None = None) -> DataFrame:
    """``rows`` as the set ``dest``, in place of what ``into`` has under that key."""
    new = rows.select(F.lit(dest).alias("key"), "member")
    return new if into is None else into.where(F.col("key") != F.lit(dest)).select("key", "member").union(new)


def smove(s: DataFrame, source, dest, member) -> DataFrame:
    """Unchanged unless ``source`` holds ``member``."""
    moved = F.when((F.col("key") == F.lit(source)) & (F.col("member") == F.lit(member)), F.lit(dest)).otherwise(F.col("key"))
    return s.select(moved.alias("key"), "member").distinct()


def srandmember(s: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct members of every key, in a seeded hash order; -n is n draws with repeats."""
    if n < 0:
        return drawn(s, "member", -n, seed)
    pick = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "member"), "member"))
    return s.withColumn("_n", pick).where(F.col("_n") <= n).drop("_n")


def spop(s: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """What is popped, and what stays."""
    gone = srandmember(s, n, seed)
    return gone, srem(s, gone)


def sscan(s: DataFrame, cursor: int, *, pattern: str = "*", count: int = 10) -> DataFrame:
    page = s.withColumn("_i", F.row_number().over(Window.partitionBy("key").orderBy("member")))
    page = page.where((F.col("_i") > cursor) & (F.col("_i") <= cursor + count)).drop("_i")
    return page.where(matches(F.col("member").cast("string"), pattern, keys=True))
