"""Atomic batches: all writes of a batch become one new snapshot, or none do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.strings import set_last, upsert
from keyloom.plans import replay


def unchanged(watched: DataFrame, current: DataFrame) -> DataFrame:
    """One row, ``_ok``: whether every watched (key, version) still is the current one."""
    now = current.select("key", F.col("version").alias("_now"))
    moved = watched.join(now, "key", "left").where(~F.col("version").eqNullSafe(F.col("_now")))
    return moved.agg((F.count(F.lit(1)) == 0).alias("_ok"))


def execute(kv: DataFrame, batch: DataFrame, *, watched: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """The snapshot after the batch (key, seq, value), or ``kv`` as it was if a watched key moved."""
    if watched is not None:
        batch = batch.crossJoin(F.broadcast(unchanged(watched, current))).where("_ok").drop("_ok")  # one row
    return upsert(kv, set_last(batch))


def execute_commands(kv: DataFrame, commands: DataFrame, *, watched: DataFrame | None = None, current: DataFrame | None = None) -> DataFrame:
    """The snapshot after a batch of any string commands (key, seq, cmd, args), keys as text, or
    ``kv`` as it was if a watched key moved. Keys that the batch does not name are not folded."""
    if watched is not None:
        commands = commands.crossJoin(F.broadcast(unchanged(watched, current))).where("_ok").drop("_ok")  # one row
    text = kv.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    named = commands.select(F.col("key").cast("string").alias("key")).distinct()
    first = commands.agg(F.min("seq").alias("_s"))
    before = text.join(named, "key", "left_semi").crossJoin(F.broadcast(first))  # one row
    log = before.select("key", (F.col("_s") - 1).cast("long").alias("seq"), F.lit("SET").alias("cmd"), F.array("value").alias("args"))
    done = replay.mixed(log.union(commands.select(F.col("key").cast("string"), F.col("seq").cast("long"), "cmd", "args")))
    return text.join(named, "key", "left_anti").union(done.select("key", "value"))


def versions(log: DataFrame) -> DataFrame:
    """(key, version): the seq of each key's last write, which WATCH remembers."""
    return log.groupBy("key").agg(F.max("seq").alias("version"))
