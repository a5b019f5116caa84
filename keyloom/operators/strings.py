"""Strings and counters: rows (key, value), and logs (key, value, seq) of writes to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.keyspace import live


def set_last(log: DataFrame) -> DataFrame:
    """SET: the last write of each key."""
    return log.groupBy("key").agg(F.max_by("value", "seq").alias("value"))


def setnx(log: DataFrame, kv: DataFrame | None = None) -> DataFrame:
    """SETNX: the first write of each key that ``kv`` does not have."""
    first = log.groupBy("key").agg(F.min_by("value", "seq").alias("value"))
    return first if kv is None else first.join(kv.select("key"), "key", "left_anti")


def setxx(log: DataFrame, kv: DataFrame) -> DataFrame:
    """SET XX: the last write of each key that ``kv`` has."""
    return set_last(log.join(kv.select("key"), "key", "left_semi"))


def set_with(kv: DataFrame, log: DataFrame, now: int, *, mode: str = "", keepttl: bool = False) -> tuple[DataFrame, DataFrame]:
    """SET with options: a log (key, seq, value, expire_at; ms or null) over ``kv`` (key, value,
    expire_at). mode "NX" writes only where no live key is, "XX" only where one is; ``keepttl`` leaves
    a live key's deadline. The replies of SET GET (key, old: the value before the first write, or
    null) and the snapshot after; a deadline that is not in the future deletes.
    """
    if mode not in ("", "NX", "XX"):
        raise ValueError("syntax error")
    alive = live(kv, now).select("key", F.col("value").alias("_old"), F.col("expire_at").alias("_due"), F.lit(True).alias("_had"))
    pick = F.min_by if mode == "NX" else F.max_by
    new = log.groupBy("key").agg(pick(F.struct("value", "expire_at"), "seq").alias("w"))
    both = new.join(alive, "key", "full")
    had, asked = F.col("_had").isNotNull(), F.col("w").isNotNull()
    go = asked & {"": F.lit(True), "NX": ~had, "XX": had}[mode]
    due = F.when(had, F.col("_due")) if keepttl else F.col("w.expire_at")
    after = both.where(go | had).select("key", F.when(go, F.col("w.value")).otherwise(F.col("_old")).alias("value"), F.when(go, due).otherwise(F.col("_due")).alias("expire_at"))
    return both.where(asked).select("key", F.col("_old").alias("old")), live(after, now)


def deadlines(log: DataFrame, now: int, unit: str) -> DataFrame:
    """``ttl`` of each write as ``expire_at`` in ms: EX, PX from now (SETEX, PSETEX; not above 0 is an
    error), EXAT, PXAT as they stand (below 0 is 0)."""
    ms = F.col("ttl").cast("long") * (1000 if unit in ("EX", "EXAT") else 1)
    if unit in ("EXAT", "PXAT"):
        at = F.when(ms < 0, 0).otherwise(ms)
    else:
        at = F.when(F.col("ttl") <= 0, F.raise_error(F.lit("invalid expire time")).cast("long")).otherwise(ms + now)
    return log.withColumn("expire_at", at).drop("ttl")


def upsert(kv: DataFrame, new: DataFrame) -> DataFrame:
    return kv.join(new.select("key"), "key", "left_anti").select("key", "value").union(new.select("key", "value"))


def msetnx(kv: DataFrame, new: DataFrame) -> DataFrame:
    """All of ``new`` or nothing: only if ``kv`` has none of its keys."""
    clash = new.join(kv.select("key"), "key", "left_semi").agg((F.count(F.lit(1)) == 0).alias("_free"))
    wanted = new.crossJoin(F.broadcast(clash)).where("_free").select("key", "value")  # one row
    return kv.select("key", "value").union(wanted)


def mget(kv: DataFrame, request: DataFrame) -> DataFrame:
    """request: (pos, key); value null where the key is absent."""
    return request.join(kv, "key", "left").select("pos", "key", "value")


def getset(log: DataFrame) -> DataFrame:
    """Each write with the value it replaced."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def getdel(kv: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The values read, and what stays."""
    return kv.join(keys, "key", "left_semi"), kv.join(keys, "key", "left_anti")


def incr_running(log: DataFrame) -> DataFrame:
    """INCRBY replies: the value after each delta; 64-bit overflow is an error."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return log.withColumn("after", F.sum("delta").over(w))


def incrbyfloat_running(log: DataFrame) -> DataFrame:
    """INCRBYFLOAT replies; a value that is not finite is an error."""
    after = F.col("after")
    bad = F.isnan(after) | (F.abs(after) == float("inf"))
    refused = F.raise_error(F.lit("increment would produce NaN or Infinity")).cast("double")
    return incr_running(log).withColumn("after", F.when(bad, refused).otherwise(after))


def incr_net(log: DataFrame, kv: DataFrame | None = None) -> DataFrame:
    """The counters after all deltas, absent ones from 0; text that is no integer is an error."""
    rows = log.select("key", "delta")
    if kv is not None:
        rows = rows.union(kv.select("key", F.col("value").cast("long")))
    return rows.groupBy("key").agg(F.sum("delta").alias("value"))


def append(log: DataFrame, kv: DataFrame | None = None) -> DataFrame:
    """APPEND: the values of each key joined in order. A key's whole value is one row, as its string is."""
    rows = log.select("key", F.struct("seq", F.col("value").alias("v")).alias("_p"))
    if kv is not None:
        rows = rows.union(kv.select("key", F.struct(F.lit(None).cast("long").alias("seq"), F.col("value").alias("v"))))
    joined = rows.groupBy("key").agg(F.sort_array(F.collect_list("_p")).alias("_p"))
    return joined.select("key", F.array_join(F.transform("_p", lambda p: p["v"]), "").alias("value"))


def strlen(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def getrange(value: Column, start: int, end: int) -> Column:
    """Inclusive byte range as binary; counted from the end where negative."""
    raw = value.cast("binary")
    n = F.octet_length(raw)
    place = lambda i: F.greatest(n + i, F.lit(0)) if i < 0 else F.lit(i)
    last = F.least(n - 1, n + end if end < 0 else F.lit(end))
    first = place(start)
    return F.substring(raw, first + 1, F.greatest(F.lit(0), last - first + 1))


def setrange(value: Column, offset: int, new: str) -> Column:
    """Zero bytes fill up to ``offset``; an empty ``new`` changes nothing."""
    if not 0 <= offset <= 536870911:
        raise ValueError("offset is out of range")
    raw = F.coalesce(value.cast("binary"), F.lit(b""))
    if not new:
        return raw
    n, size = F.octet_length(raw), len(new.encode())
    head = F.when(n >= offset, F.substring(raw, F.lit(1), F.lit(offset))).otherwise(F.rpad(raw, offset, b"\x00"))
    return F.concat(head, F.lit(new.encode()), F.substring(raw, F.lit(offset + size + 1), F.greatest(F.lit(0), n - offset - size)))
