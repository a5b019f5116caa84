"""Lists: rows (key, pos, value). pos only orders; an index is the rank of pos within the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.ranges import index_range


def _from_end(tail: bool = False) -> Window:
    return Window.partitionBy("key").orderBy(F.col("pos").desc() if tail else F.col("pos").asc())


def push(log: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """A log (key, seq, side, value) of LPUSH ("L") and RPUSH ("R"): left pushes take falling places.

    Existing items keep their order between the two."""
    side = F.when(F.col("side") == "L", -F.col("seq") - 1).otherwise(F.col("seq") + 1)
    rows = log.select("key", F.when(F.col("side") == "L", F.lit(0)).otherwise(F.lit(2)).alias("part"), side.alias("at"), "value")
    if items is not None:
        rows = rows.union(items.select("key", F.lit(1).alias("part"), F.col("pos").alias("at"), "value"))
    order = Window.partitionBy("key").orderBy("part", "at")
    return rows.select("key", (F.row_number().over(order) - 1).cast("long").alias("pos"), "value")


def pushx(log: DataFrame, items: DataFrame) -> DataFrame:
    """Only onto lists that exist."""
    return push(log.join(items.select("key").distinct(), "key", "left_semi"), items)


def llen(items: DataFrame) -> DataFrame:
    return items.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def lrange(items: DataFrame, start: int, stop: int) -> DataFrame:
    return index_range(items, ["key"], [F.col("pos").asc()], [F.col("pos").desc()], start, stop)


def ltrim(items: DataFrame, start: int, stop: int) -> DataFrame:
    return lrange(items, start, stop)


def lindex(items: DataFrame, index: int) -> DataFrame:
    """At most one row for each key."""
    return lrange(items, index, index)


def lpop(items: DataFrame, n: int, *, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """What is popped from every key, and what stays."""
    popped = lrange(items, -n, -1) if right else lrange(items, 0, n - 1)
    return popped, items.join(popped.select("key", "pos"), ["key", "pos"], "left_anti")


def lset(items: DataFrame, index: int, value: str) -> DataFrame:
    """In every list; one that is too short is an error."""
    place = F.row_number().over(_from_end()) - 1 if index >= 0 else -F.row_number().over(_from_end(True))
    needed = index + 1 if index >= 0 else -index
    rows = items.withColumns({"_i": place, "_n": F.count(F.lit(1)).over(Window.partitionBy("key"))})
    short = F.raise_error(F.lit("index out of range")).cast("string")
    new = F.when(F.col("_n") < needed, short).when(F.col("_i") == index, F.lit(value)).otherwise(F.col("value"))
    return rows.select("key", "pos", new.alias("value"))


def linsert(items: DataFrame, pivot: str, value: str, *, before: bool = True) -> DataFrame:
    """Next to the first ``pivot`` of every list that has one; places are dealt anew."""
    at = items.where(F.col("value") == pivot).groupBy("key").agg(F.min("pos").alias("pos"))
    new = at.select("key", "pos", F.lit(value).alias("value"), F.lit(-1 if before else 1).alias("_s"))
    every = items.select("key", "pos", "value", F.lit(0).alias("_s")).union(new)
    return every.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("pos", "_s")) - 1).cast("long").alias("pos"), "value")


def lrem(items: DataFrame, count: int, value: str) -> DataFrame:
    """count > 0 from the head, < 0 from the tail, 0 all."""
    same = F.col("value") == value
    if count == 0:
        return items.where(~same)
    hits = items.where(same).withColumn("_n", F.row_number().over(_from_end(count < 0))).where(F.col("_n") <= abs(count))
    return items.join(hits.select("key", "pos"), ["key", "pos"], "left_anti")


def lpos(items: DataFrame, value: str, *, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """(key, index) of matches from the rank-th on, from the tail where rank is negative; count 0 is
    all, maxlen bounds how many items are looked at. Indexes are from the head."""
    if rank == 0:
        raise ValueError("RANK can't be zero")
    rows = items.withColumns({"_i": F.row_number().over(_from_end()) - 1, "_j": F.row_number().over(_from_end(rank < 0))})
    rows = rows.where(F.col("value") == value)
    if maxlen:
        rows = rows.where(F.col("_j") <= maxlen)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("_j")))
    kept = F.col("_n") >= abs(rank)
    if count:
        kept = kept & (F.col("_n") < abs(rank) + count)
    return rows.where(kept).select("key", F.col("_i").cast("long").alias("index"))


def lmpop(items: DataFrame, keys: list, n: int, *, right: bool = False) -> DataFrame:
    """From the first of ``keys`` that has items."""
    place = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    some = items.where(F.col("key").isin(keys)).withColumn("_p", place[F.col("key")])
    first = some.agg(F.min("_p").alias("_p"))
    return lpop(some.join(F.broadcast(first), "_p").drop("_p"), n, right=right)[0]


def lmove(items: DataFrame, source, dest, *, take_right: bool = False, put_right: bool = False) -> DataFrame:
    """One item from an end of ``source`` to an end of ``dest``; the same key rotates."""
    moved, rest = lpop(items.where(F.col("key") == F.lit(source)), 1, right=take_right)
    rest = rest.union(items.where(F.col("key") != F.lit(source)))
    new = moved.select(F.lit(dest).alias("key"), F.lit(2 if put_right else 0).alias("part"), "pos", "value")
    every = rest.select("key", F.lit(1).alias("part"), "pos", "value").union(new)
    return every.select("key", (F.row_number().over(Window.partitionBy("key").orderBy("part", "pos")) - 1).cast("long").alias("pos"), "value")
