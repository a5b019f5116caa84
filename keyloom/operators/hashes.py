"""Hashes: rows (key, field, value, expire_at), fields of a key in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.globs import matches
from keyloom.functions.ranges import drawn
from keyloom.operators.keyspace import live, may_expire


def hset(log: DataFrame) -> DataFrame:
    """The last write of each field; a plain write has no deadline."""
    return log.groupBy("key", "field").agg(F.max_by("value", "seq").alias("value"))


def hsetnx(log: DataFrame, h: DataFrame) -> DataFrame:
    """The first write of each field that ``h`` does not have."""
    return log.groupBy("key", "field").agg(F.min_by("value", "seq").alias("value")).join(h.select("key", "field"), ["key", "field"], "left_anti")


def hset_new(log: DataFrame, h: DataFrame) -> DataFrame:
    """How many fields of each key are new."""
    return log.select("key", "field").distinct().join(h.select("key", "field"), ["key", "field"], "left_anti").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def hmget(h: DataFrame, request: DataFrame) -> DataFrame:
    """request: (pos, key, field); value null where absent."""
    return request.join(h.select("key", "field", "value"), ["key", "field"], "left").select("pos", "key", "field", "value")


def hgetall(h: DataFrame) -> DataFrame:
    """One map for each key, as the hash is one value."""
    return h.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("fields"))


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def hexists(h: DataFrame, request: DataFrame) -> DataFrame:
    return request.join(h.select("key", "field"), ["key", "field"], "left_semi")


def hdel(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone.select("key", "field"), ["key", "field"], "left_anti")


def hincrby(log: DataFrame, h: DataFrame | None = None) -> DataFrame:
    rows = log.select("key", "field", "delta")
    if h is not None:
        rows = rows.union(h.select("key", "field", F.col("value").cast("long")))
    return rows.groupBy("key", "field").agg(F.sum("delta").alias("value"))


def hincrbyfloat(log: DataFrame, h: DataFrame | None = None, now: int | None = None) -> DataFrame:
    """(key, field, value, expire_at) of the fields of a log (key, field, delta) after all increments:
    a field keeps its deadline, one that has expired begins anew, as an absent one does. A result that
    is not finite is an error. Values are text."""
    rows = log.select("key", "field", F.col("delta").cast("double").alias("delta"), F.lit(None).cast("long").alias("expire_at"), F.lit(1).alias("_asked"))
    if h is not None:
        held = h if "expire_at" in h.columns else h.withColumn("expire_at", F.lit(None).cast("long"))
        held = held if now is None else live(held, now)
        rows = rows.union(held.select("key", "field", F.col("value").cast("double"), "expire_at", F.lit(0)))
    out = rows.groupBy("key", "field").agg(F.sum("delta").alias("x"), F.max("expire_at").alias("expire_at"), F.max("_asked").alias("_asked")).where("_asked = 1")
    bad = F.isnan("x") | (F.abs("x") == float("inf"))
    value = F.when(bad, F.raise_error(F.lit("value is NaN or Infinity")).cast("string")).otherwise(float_text(F.col("x")))
    return out.select("key", "field", value.alias("value"), "expire_at")


def hstrlen(h: DataFrame, request: DataFrame) -> DataFrame:
    """(key, field, n) of each request: bytes of the value, 0 where there is none."""
    at = request.select("key", "field").join(h.select("key", "field", "value"), ["key", "field"], "left")
    return at.select("key", "field", F.coalesce(F.octet_length("value"), F.lit(0)).alias("n"))


def float_text(x: Column) -> Column:
    """Integral results are written as integers, -0 as 0."""
    x = x + F.lit(0.0)
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e17), x.cast("long").cast("string")).otherwise(x.cast("string"))


def hexpire(h: DataFrame, new_at: Column, now: int, condition: str = "") -> DataFrame:
    """(key, field, code, expire_at) of every field, ms: -2 it has expired already, 2 deleted at once,
    1 set, 0 the condition failed; a field that is gone has no deadline. HEXPIRE, HEXPIREAT and their
    forms in ms differ in how ``new_at`` is reckoned."""
    old = F.col("expire_at")
    code = F.when(old <= now, -2).when(~may_expire(old, new_at, condition), 0).when(new_at <= now, 2).otherwise(1)
    return h.select("key", "field", code.alias("code"), F.when(code == 1, new_at).when(code == 0, old).alias("expire_at"))


def httl(h: DataFrame, request: DataFrame, now: int) -> DataFrame:
    """Seconds, truncated; -1 without a deadline, -2 without the field."""
    at = request.join(h.where(F.col("expire_at").isNull() | (F.col("expire_at") > now)).select("key", "field", "expire_at", F.lit(True).alias("_in")), ["key", "field"], "left")
    return at.select("key", "field", F.when(F.col("_in").isNull(), F.lit(-2)).when(F.col("expire_at").isNull(), F.lit(-1)).otherwise(F.floor((F.col("expire_at") - now) / 1000)).cast("long").alias("ttl"))


def hpersist(h: DataFrame, request: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(key, field, code) of each request, 1 where a deadline was dropped and -1 else, and the fields after."""
    alive = live(h, now)
    had = alive.where("expire_at IS NOT NULL").select("key", "field", F.lit(True).alias("_p"))
    reply = request.select("key", "field").join(had, ["key", "field"], "left").select("key", "field", F.when(F.col("_p"), 1).otherwise(-1).alias("code"))
    asked = request.select("key", "field", F.lit(True).alias("_p")).distinct()
    after = alive.join(asked, ["key", "field"], "left")
    return reply, after.withColumn("expire_at", F.when(F.col("_p").isNull(), F.col("expire_at"))).drop("_p")


def hcollect(h: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """How many fields of each key have expired, and the fields without them."""
    return h.groupBy("key").agg(F.count_if(F.col("expire_at") <= now).alias("n")), live(h, now)


def hscan(h: DataFrame, cursor: int, *, pattern: str = "*", count: int = 10) -> DataFrame:
    page = h.withColumn("_i", F.row_number().over(Window.partitionBy("key").orderBy("field")))
    page = page.where((F.col("_i") > cursor) & (F.col("_i") <= cursor + count)).drop("_i")
    return page.where(matches(F.col("field"), pattern, keys=True))


def hrandfield(h: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct fields of every key, in a seeded hash order; -n is n draws with repeats."""
    if n < 0:
        return drawn(h, "field", -n, seed)
    pick = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "field"), "field"))
    return h.withColumn("_n", pick).where(F.col("_n") <= n).drop("_n")
