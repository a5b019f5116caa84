"""Keys and their expiry: rows with ``key`` and ``expire_at`` (ms, null for none)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.globs import matches


def live(df: DataFrame, now: int) -> DataFrame:
    """Reads behave as if expired rows were not there."""
    return df.where(F.col("expire_at").isNull() | (F.col("expire_at") > now))


def pttl(df: DataFrame, request: DataFrame, now: int) -> DataFrame:
    """(key, pttl): -2 for a missing or expired key, -1 without expiry."""
    at = request.join(live(df, now).select("key", "expire_at", F.lit(True).alias("_in")), "key", "left")
    return at.select("key", F.when(F.col("_in").isNull(), F.lit(-2)).when(F.col("expire_at").isNull(), F.lit(-1)).otherwise(F.col("expire_at") - now).cast("long").alias("pttl"))


def ttl(df: DataFrame, request: DataFrame, now: int) -> DataFrame:
    """Seconds, rounded up."""
    ms = F.col("pttl")
    return pttl(df, request, now).select("key", F.when(ms < 0, ms).otherwise(F.floor((ms + 999) / 1000)).cast("long").alias("ttl"))


def expiretime(at: Column) -> Column:
    """The deadline in seconds, truncated; -1 without one."""
    return F.coalesce(F.floor(at / 1000), F.lit(-1)).cast("long")


def may_expire(old: Column, new_at: Column, condition: str) -> Column:
    """Whether NX, XX, GT or LT lets a deadline be set. No deadline is later than any: GT fails on it
    and LT succeeds."""
    ok = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (new_at > old), "LT": old.isNull() | (new_at < old)}[condition]
    return F.coalesce(ok, F.lit(False))


def expire(df: DataFrame, new_at: Column, now: int, condition: str = "") -> DataFrame:
    """New deadlines for the keys that are alive; one that is not in the future deletes, and a key
    that has expired stays gone."""
    old = F.col("expire_at")
    return live(live(df, now).withColumn("expire_at", F.when(may_expire(old, new_at, condition), new_at).otherwise(old)), now)


def expire_replies(df: DataFrame, request: DataFrame, now: int, condition: str = "") -> DataFrame:
    """(key, reply) of requests (key, new_at): 1 where the deadline was set, 0 where the key is missing
    or expired or the condition failed."""
    alive = live(df, now).select("key", "expire_at", F.lit(True).alias("_in"))
    ok = F.col("_in").isNotNull() & may_expire(F.col("expire_at"), F.col("new_at"), condition)
    return request.join(alive, "key", "left").select("key", ok.cast("int").alias("reply"))


def persist(df: DataFrame, keys: DataFrame, now: int) -> DataFrame:
    """The keys that are alive, those of ``keys`` (each once) without a deadline."""
    hit = live(df, now).join(keys.select("key").withColumn("_p", F.lit(True)), "key", "left")
    return hit.withColumn("expire_at", F.when(F.col("_p").isNull(), F.col("expire_at"))).drop("_p")


def getex(kv: DataFrame, keys: DataFrame, now: int, new_at: Column | None = None, *, drop: bool = False) -> tuple[DataFrame, DataFrame]:
    """The values of ``keys`` (null where there is none) and the snapshot after: their deadline is
    ``new_at``, or dropped (PERSIST), or left as it is; one that is not in the future deletes."""
    alive = live(kv, now)
    reply = keys.join(alive.select("key", "value"), "key", "left")
    if drop:
        return reply, persist(alive, keys.distinct(), now)
    if new_at is None:
        return reply, alive
    hit = alive.join(keys.select("key").distinct().withColumn("_g", F.lit(True)), "key", "left")
    return reply, live(hit.withColumn("expire_at", F.when(F.col("_g"), new_at).otherwise(F.col("expire_at"))), now).drop("_g")


def expdelscan(df: DataFrame, now: int) -> DataFrame:
    return df.agg(F.count_if(F.col("expire_at") <= now).alias("expired"), F.count(F.lit(1)).alias("scanned"))


def keys_matching(df: DataFrame, pattern: str) -> DataFrame:
    return df.where(matches(F.col("key").cast("string"), pattern, keys=True)).select("key").distinct()


def exists(df: DataFrame, request: DataFrame) -> DataFrame:
    """How many of the keys asked for exist; one asked for twice counts twice."""
    return request.join(df.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def delete(df: DataFrame, keys: DataFrame) -> DataFrame:
    return df.join(keys.select("key"), "key", "left_anti")


def rename(df: DataFrame, old, new, *, nx: bool = False) -> DataFrame:
    """The target's rows give way; a missing source leaves all as it is, as does one name for both.
    With ``nx`` (RENAMENX) an existing target does so too."""
    if old == new:
        return df
    own = F.col("key")
    moves = df.where((own == F.lit(old)) | (own == F.lit(new))).agg(F.max(own == F.lit(old)).alias("_has"), F.max(own == F.lit(new)).alias("_full"))
    go = F.coalesce("_has", F.lit(False)) & ~(F.coalesce("_full", F.lit(False)) if nx else F.lit(False))
    rows = df.crossJoin(F.broadcast(moves.select(go.alias("_go"))))  # one row
    rows = rows.where(~(F.col("_go") & (own == F.lit(new))))
    return rows.withColumn("key", F.when(F.col("_go") & (own == F.lit(old)), F.lit(new)).otherwise(own)).drop("_go")


def rename_reply(df: DataFrame, old, new, *, nx: bool = False) -> DataFrame:
    """One row, ``reply``: null for no such key; RENAME 1, RENAMENX 1 or 0."""
    own = F.col("key")
    seen = df.agg(F.max(own == F.lit(old)).alias("has"), F.max(own == F.lit(new)).alias("full"))
    taken = F.lit(nx) & F.coalesce("full", F.lit(False))
    return seen.select(F.when(F.col("has"), (~taken).cast("int")).alias("reply"))


def scan(df: DataFrame, cursor: int, *, pattern: str = "*", count: int = 10) -> DataFrame:
    """A page of the keys in their order, from the ``cursor``-th on; the cursor also advances over keys
    that do not match. The page is the first cursor + count keys of each task, then of all."""
    keys = df.select(F.col("key").cast("string").alias("key")).distinct().orderBy("key").offset(cursor).limit(count)
    return keys.where(matches(F.col("key"), pattern, keys=True))


def select_db(df: DataFrame, db, ns=0) -> DataFrame:
    """The keys of one database of a tenant, from rows that also have ``ns`` and ``db``; with tables
    partitioned by these the filter prunes folders."""
    return df.where((F.col("ns") == F.lit(ns)) & (F.col("db") == F.lit(db)))


def flushdb(df: DataFrame, db, ns=0) -> DataFrame:
    """Without the keys of one database of a tenant."""
    return df.where(~((F.col("ns") == F.lit(ns)) & (F.col("db") == F.lit(db))))


def flushall(df: DataFrame, ns=0) -> DataFrame:
    """Without the keys of a tenant."""
    return df.where(F.col("ns") != F.lit(ns))


def swapdb(df: DataFrame, first, second, ns=0) -> DataFrame:
    """Two databases of a tenant change their numbers."""
    db = F.when(F.col("db") == F.lit(first), F.lit(second)).when(F.col("db") == F.lit(second), F.lit(first)).otherwise(F.col("db"))
    return df.withColumn("db", F.when(F.col("ns") == F.lit(ns), db).otherwise(F.col("db")))


def wrong_type(keys: DataFrame, typed_: DataFrame, kind: str) -> DataFrame:
    """``keys``, if each that exists has the type ``kind`` in (key, type); else an error."""
    other = typed_.where(F.col("type") != kind).select("key", F.lit(True).alias("_other"))
    held = keys.join(other, "key", "left")
    refused = F.raise_error(F.lit("WRONGTYPE Operation against a key holding the wrong kind of value"))
    return held.withColumn("key", F.when(F.col("_other"), refused.cast(keys.schema["key"].dataType)).otherwise(F.col("key"))).drop("_other")


def typed(tables: dict[str, DataFrame]) -> DataFrame:
    """(key, type) over one table for each type."""
    return reduce(DataFrame.union, [t.select(F.col("key").cast("string").alias("key"), F.lit(name).alias("type")).distinct() for name, t in tables.items()])


def dbsize(tables: dict[str, DataFrame]) -> DataFrame:
    return typed(tables).select("key").distinct().agg(F.count(F.lit(1)).alias("n"))
