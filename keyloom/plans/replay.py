"""Replay of a command log (key, seq, cmd, args) into snapshots.

Commands whose effect needs only the last, or only a sum, become aggregates for each key or element:
what came before the last command that starts anew (SET, ZADD, DEL) counts no more. Only mixes
whose order matters are folded key by key, in Arrow batches that arrive sorted by seq; the state of
a key is its value alone, so a key with very many commands is a stream, not a group in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _arg(n: int) -> Column:
    return F.get("args", F.lit(n))


def strings(log: DataFrame) -> DataFrame:
    """SET, MSET (key, value, key, value, ...) and DEL: the last command of each key decides."""
    pairs = F.when(F.col("cmd") == "MSET", F.transform(F.sequence(F.lit(0), F.size("args") - 2, F.lit(2)), lambda i: F.struct(F.get("args", i).alias("key"), F.get("args", i + 1).alias("value"))))
    one = F.array(F.struct(F.col("key").cast("string").alias("key"), _arg(0).alias("value")))
    each = log.where(F.col("cmd").isin("SET", "MSET", "DEL")).select("seq", "cmd", F.explode(F.coalesce(pairs, one)).alias("p"))
    last = each.groupBy("p.key").agg(F.max_by(F.struct("cmd", "p.value"), F.struct("seq")).alias("w"))
    return last.where("w.cmd <> 'DEL'").select(F.col("key").cast(log.schema["key"].dataType).alias("key"), "w.value")


def _since_del(log: DataFrame, cmds: list[str]) -> DataFrame:
    """The commands ``cmds`` of each key after its last DEL."""
    gone = log.where("cmd = 'DEL'").groupBy("key").agg(F.max("seq").alias("_gone"))
    return log.where(F.col("cmd").isin(cmds)).join(gone, "key", "left").where(F.coalesce(F.col("seq") > F.col("_gone"), F.lit(True))).drop("_gone")


def hashes(log: DataFrame) -> DataFrame:
    """HSET (field, value) and HDEL (field), and DEL of the key."""
    last = _since_del(log, ["HSET", "HDEL"]).groupBy("key", _arg(0).alias("field")).agg(F.max_by(F.struct("cmd", _arg(1).alias("value")), "seq").alias("w"))
    return last.where("w.cmd = 'HSET'").select("key", "field", "w.value")


def sets(log: DataFrame) -> DataFrame:
    """SADD and SREM (member), and DEL of the key."""
    last = _since_del(log, ["SADD", "SREM"]).groupBy("key", _arg(0).alias("member")).agg(F.max_by("cmd", "seq").alias("cmd"))
    return last.where("cmd = 'SADD'").select("key", "member")


def range_indexes(log: DataFrame) -> DataFrame:
    """RI.SET (k, v) and RI.DEL (k), and DEL of the key, as (key, k, v)."""
    last = _since_del(log, ["RI.SET", "RI.DEL"]).groupBy("key", _arg(0).alias("k")).agg(F.max_by(F.struct("cmd", _arg(1).alias("v")), "seq").alias("w"))
    return last.where("w.cmd = 'RI.SET'").select("key", "k", "w.v")


def zsets(log: DataFrame) -> DataFrame:
    """ZADD (score, member), ZINCRBY (increment, member) and ZREM (member), and DEL of the key: the
    score that the last ZADD or ZREM of a member left, and the increments after it."""
    rows = _since_del(log, ["ZADD", "ZINCRBY", "ZREM"])
    removed = F.col("cmd") == "ZREM"
    rows = rows.select("key", "seq", "cmd", F.when(removed, _arg(0)).otherwise(_arg(1)).alias("member"), F.when(~removed, _arg(0)).cast("double").alias("by"))
    anew = rows.where("cmd <> 'ZINCRBY'").groupBy("key", "member").agg(F.max("seq").alias("_from"), F.max_by("by", "seq").alias("_base"))
    each = rows.where("cmd = 'ZINCRBY'").join(anew.select("key", "member", "_from"), ["key", "member"], "left")
    added = each.where(F.coalesce(F.col("seq") > F.col("_from"), F.lit(True))).groupBy("key", "member").agg(F.sum("by").alias("_by"))
    both = anew.join(added, ["key", "member"], "full").where("_base IS NOT NULL OR _by IS NOT NULL")
    return both.select("key", "member", (F.coalesce("_base", F.lit(0.0)) + F.coalesce("_by", F.lit(0.0))).alias("score"))


class _Counter:
    """The value of one key under SET, APPEND, INCRBY, GETDEL and DEL."""

    def __init__(self) -> None:
        self.value: str | None = None

    def apply(self, cmd: str, arg: str | None) -> None:
        if cmd == "SET":
            self.value = arg
        elif cmd == "APPEND":
            self.value = (self.value or "") + (arg or "")
        elif cmd == "INCRBY":
            new = int(self.value or "0") + int(arg)
            if not -(1 << 63) <= new < 1 << 63:
                raise OverflowError("increment or decrement would overflow")
            self.value = str(new)
        elif cmd in ("DEL", "GETDEL"):
            self.value = None


def mixed(log: DataFrame) -> DataFrame:
    """(key, value) after commands whose order matters, such as SET after INCRBY. Only each key's last
    SET, DEL or GETDEL and what follows it is folded."""
    rows = log.select(F.col("key").cast("string").alias("key"), "seq", "cmd", _arg(0).alias("arg"))
    anew = rows.where(F.col("cmd").isin("SET", "DEL", "GETDEL")).groupBy("key").agg(F.max("seq").alias("_from"))
    rows = rows.join(anew, "key", "left").where(F.coalesce(F.col("seq") >= F.col("_from"), F.lit(True))).drop("_from")
    rows = rows.repartition("key").sortWithinPartitions("key", "seq")

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, _Counter(), []
        for batch in batches:
            for key, cmd, arg in zip(batch["key"], batch["cmd"], batch["arg"], strict=True):
                if key != now:
                    if now is not None and state.value is not None:
                        out.append((now, state.value))
                    now, state = key, _Counter()
                state.apply(cmd, arg)
            yield pd.DataFrame(out, columns=["key", "value"])
            out = []
        if now is not None and state.value is not None:
            yield pd.DataFrame([(now, state.value)], columns=["key", "value"])

    return rows.mapInPandas(fold, "key string, value string")
