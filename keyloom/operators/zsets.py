"""Sorted sets: rows (key, member, score), ordered by score and then by the member's bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.globs import matches
from keyloom.functions.ranges import index_range, lex_within, score_within
from keyloom.operators.keyspace import live


def _order(rev: bool = False) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if rev else [F.col("score").asc(), F.col("member").asc()]


def _window(rev: bool = False) -> Window:
    return Window.partitionBy("key").orderBy(*_order(rev))


def zrange(z: DataFrame, start: int, stop: int, *, rev: bool = False, limit: tuple[int, int] | None = None) -> DataFrame:
    """A stop that stays below 0 after counting from the end selects nothing."""
    rows = index_range(z, ["key"], _order(rev), _order(not rev), start, stop)
    return limited(rows, *limit, rev=rev) if limit else rows


def zrank(z: DataFrame, *, rev: bool = False) -> DataFrame:
    return z.withColumn("rank", (F.row_number().over(_window(rev)) - 1).cast("long"))


def limited(rows: DataFrame, offset: int, count: int, *, rev: bool = False) -> DataFrame:
    """LIMIT within every key; a negative count is all."""
    n = F.row_number().over(_window(rev))
    kept = F.col("_n") > offset
    if count >= 0:
        kept = kept & (F.col("_n") <= offset + count)
    return rows.withColumn("_n", n).where(kept).drop("_n")


def zrangebyscore(z: DataFrame, low: float | str, high: float | str, *, rev: bool = False, limit: tuple[int, int] | None = None) -> DataFrame:
    rows = z.where(score_within(F.col("score"), low, high))
    return limited(rows, *limit, rev=rev) if limit else rows


def zrangebylex(z: DataFrame, low: str, high: str, *, rev: bool = False, limit: tuple[int, int] | None = None) -> DataFrame:
    rows = z.where(lex_within(F.col("member"), low, high))
    return limited(rows, *limit, rev=rev) if limit else rows


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def zcount(z: DataFrame, low: float | str, high: float | str) -> DataFrame:
    """Keys without such members are absent."""
    return zcard(zrangebyscore(z, low, high))


def zlexcount(z: DataFrame, low: str, high: str) -> DataFrame:
    return zcard(zrangebylex(z, low, high))


def zmscore(z: DataFrame, request: DataFrame) -> DataFrame:
    """Scores of the (key, member) rows asked for, null where absent; the request's columns stay."""
    return request.join(z, ["key", "member"], "left")


def zpop(z: DataFrame, n: int, *, largest: bool = False) -> DataFrame:
    """The n lowest, or highest, members of every key."""
    return zrange(z, 0, n - 1, rev=largest)


def without(z: DataFrame, gone: DataFrame) -> DataFrame:
    """The snapshot after the members ``gone`` are removed."""
    return z.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    return without(z, zrange(z, start, stop))


def zremrangebyscore(z: DataFrame, low: float | str, high: float | str) -> DataFrame:
    return z.where(~F.coalesce(score_within(F.col("score"), low, high), F.lit(False)))


def zremrangebylex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.where(~lex_within(F.col("member"), low, high))


def zmpop(z: DataFrame, keys: list, n: int, *, largest: bool = False) -> DataFrame:
    """From the first of ``keys`` that has members."""
    place = F.create_map(*[x for i, k in enumerate(keys) for x in (F.lit(k), F.lit(i))])
    some = z.where(F.col("key").isin(keys)).withColumn("_p", place[F.col("key")])
    first = some.agg(F.min("_p").alias("_p"))
    return zpop(some.join(F.broadcast(first), "_p").drop("_p"), n, largest=largest)


def _weighted(zs: list[DataFrame], weights: list[float] | None) -> DataFrame:
    weights = weights or [1.0] * len(zs)
    if len(weights) != len(zs):
        raise ValueError("one weight for each key")
    parts = [z.select("member", (F.col("score") * w).alias("score"), F.lit(i).alias("_src")) for i, (z, w) in enumerate(zip(zs, weights, strict=True))]
    return reduce(DataFrame.union, parts)


_AGG = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def zunion(zs: list[DataFrame], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """(member, score) over single-key sets; a sum that is not a number (inf - inf) is dropped."""
    out = _weighted(zs, weights).groupBy("member").agg(_AGG[aggregate]("score").alias("score"))
    return out.where(~F.isnan("score"))


def zinter(zs: list[DataFrame], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    out = _weighted(zs, weights).groupBy("member").agg(_AGG[aggregate]("score").alias("score"), F.count(F.lit(1)).alias("_n"))
    return out.where((F.col("_n") == len(zs)) & ~F.isnan("score")).drop("_n")


def zdiff(first: DataFrame, rest: list[DataFrame]) -> DataFrame:
    others = reduce(DataFrame.union, [r.select("member") for r in rest])
    return first.select("member", "score").join(others, "member", "left_anti")


def zintercard(zs: list[DataFrame], limit: int = 0) -> DataFrame:
    rows = zinter(zs)
    return (rows.limit(limit) if limit else rows).agg(F.count(F.lit(1)).alias("n"))


def zadd(z: DataFrame, log: DataFrame, *, mode: str = "", compare: str = "", incr: bool = False) -> DataFrame:
    """The snapshot after a log (key, member, score, seq) of ZADD with one option for all.

    mode: "" sets, "NX" only adds, "XX" only updates; "INCR", or ``incr``, adds to the score.
    compare: "GT" or "LT" lets only greater or lesser scores replace one, for increments that is
    those above or below 0. NX goes with neither. Each reduces to one aggregate for each member, so
    any number of writes combines before the shuffle. A sum that is not a number is an error.
    """
    if mode == "INCR":
        mode, incr = "", True
    if mode not in ("", "NX", "XX") or compare not in ("", "GT", "LT"):
        raise ValueError("syntax error")
    if mode == "NX" and compare:
        raise ValueError("GT, LT, and/or NX options at the same time are not compatible")
    old = z.select("key", "member", F.struct(F.lit(True).alias("old"), F.lit(None).cast("long").alias("seq"), F.col("score").cast("double").alias("score")).alias("w"))
    new = log.select("key", "member", F.struct(F.lit(False).alias("old"), F.col("seq").cast("long").alias("seq"), F.col("score").cast("double").alias("score")).alias("w"))
    every = old.union(new).where(~F.isnan("w.score"))
    had, of_log = F.max("w.old"), ~F.col("w.old")
    before = F.max(F.when(F.col("w.old"), F.col("w.score")))
    first = F.min_by("w.score", F.when(of_log, F.col("w.seq")))
    last = F.max_by("w.score", F.when(of_log, F.col("w.seq")))
    if incr:
        score = _increments(mode, compare, had, before, first)
    elif compare:
        score = {"GT": F.max, "LT": F.min}[compare]("w.score")
    elif mode == "NX":
        score = F.coalesce(before, first)
    else:
        score = F.coalesce(last, before)
    out = every.groupBy("key", "member").agg(score.alias("score"), had.alias("_had"))
    out = out.where("_had") if mode == "XX" else out
    refused = F.raise_error(F.lit("resulting score is not a number (NaN)")).cast("double")
    # -0.0 is stored as 0.0
    return out.select("key", "member", F.when(F.isnan("score"), refused).otherwise(F.col("score") + F.lit(0.0)).alias("score"))


def _increments(mode: str, compare: str, had: Column, before: Column, first: Column) -> Column:
    """An absent member takes its first increment whatever it is, so that is left out of those that
    are held against GT or LT."""
    if mode == "NX":
        return F.coalesce(before, first)
    by = F.col("w.score")
    if not compare:
        return F.sum(by)
    counts = by > 0 if compare == "GT" else by < 0
    moved = F.coalesce(F.sum(F.when(~F.col("w.old") & counts, by)), F.lit(0.0))
    again = F.when(first > 0 if compare == "GT" else first < 0, first).otherwise(0.0)  # counted in ``moved`` too
    return F.when(had, before + moved).when(F.abs(first) == float("inf"), first).otherwise(first + moved - again)


def zadd_replies(z: DataFrame, after: DataFrame, *, changed: bool = False) -> DataFrame:
    """(key, n): the members that a ZADD added, with ``changed`` (CH) also those whose score moved."""
    both = after.select("key", "member", "score").join(z.select("key", "member", F.col("score").alias("_was")), ["key", "member"], "left")
    counts = F.col("_was").isNull() | (F.col("_was") != F.col("score")) if changed else F.col("_was").isNull()
    return both.groupBy("key").agg(F.count_if(counts).alias("n"))


def zrangestore(found: DataFrame, dest, into: DataFrame | None = None, *, by_lex: bool = False) -> DataFrame:
    """What a range of one key found as the sorted set ``dest``, in place of what ``into`` has under
    that key; a range by member stores every score as 0."""
    new = found.select(F.lit(dest).alias("key"), "member", (F.lit(0.0) if by_lex else F.col("score")).alias("score"))
    return new if into is None else into.where(F.col("key") != F.lit(dest)).select("key", "member", "score").union(new)


def zrandmember(z: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n distinct members of every key, in a seeded hash order; -n is n draws with repeats."""
    if n >= 0:
        pick = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "member"), "member"))
        return z.withColumn("_n", pick).where(F.col("_n") <= n).drop("_n")
    size = z.groupBy("key").agg(F.count(F.lit(1)).alias("_size"))
    draws = size.select("key", F.explode(F.sequence(F.lit(1), F.lit(-n))).alias("draw"), "_size")
    draws = draws.select("key", "draw", (F.pmod(F.xxhash64(F.lit(seed), "key", "draw"), F.col("_size"))).alias("rank"))
    return draws.join(zrank(z), ["key", "rank"]).select("key", "member", "score")


def zscan(z: DataFrame, cursor: int, *, pattern: str = "*", count: int = 10) -> DataFrame:
    """A page by ordinal; the cursor also advances over members that do not match."""
    page = z.withColumn("_i", F.row_number().over(Window.partitionBy("key").orderBy("member")))
    page = page.where((F.col("_i") > cursor) & (F.col("_i") <= cursor + count)).drop("_i")
    return page.where(matches(F.col("member").cast("string"), pattern, keys=True))


def zexpire(z: DataFrame, request: DataFrame, now: int, condition: str = "") -> tuple[DataFrame, DataFrame]:
    """request: (key, member, new_at), ms, each member once. (key, member, code): -2 not there, 0 the
    condition failed, 1 set, 2 deleted at once; and the members with their expire_at after."""
    old, new = F.col("expire_at"), F.col("new_at")
    ok = {"": F.lit(True), "NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (new > old), "LT": old.isNull() | (new < old)}[condition]
    done = F.when(~F.coalesce(ok, F.lit(False)), 0).when(new <= now, 2).otherwise(1)
    alive, asked = live(z, now), request.select("key", "member", "new_at")
    held = alive.select("key", "member", "expire_at", F.lit(True).alias("_in"))
    reply = asked.join(held, ["key", "member"], "left").select("key", "member", F.when(F.col("_in").isNull(), -2).otherwise(done).alias("code"))
    hit = alive.join(asked, ["key", "member"], "left").withColumn("_c", F.when(new.isNull(), 0).otherwise(done))
    return reply, hit.where("_c <> 2").withColumn("expire_at", F.when(F.col("_c") == 1, new).otherwise(old)).drop("_c", "new_at")


def _deadline(z: DataFrame, request: DataFrame, now: int, of_it: Column, name: str) -> DataFrame:
    held = live(z, now).select("key", "member", "expire_at", F.lit(True).alias("_in"))
    at = request.select("key", "member").join(held, ["key", "member"], "left")
    return at.select("key", "member", F.when(F.col("_in").isNull(), F.lit(-2)).when(F.col("expire_at").isNull(), F.lit(-1)).otherwise(of_it).cast("long").alias(name))


def zttl(z: DataFrame, request: DataFrame, now: int) -> DataFrame:
    """Milliseconds, under both names of the command; -1 without a deadline, -2 without the member."""
    return _deadline(z, request, now, F.col("expire_at") - now, "ttl")


def zexpiretime(z: DataFrame, request: DataFrame, now: int, *, seconds: bool = True) -> DataFrame:
    """The deadline in truncated seconds, or in ms."""
    return _deadline(z, request, now, F.floor(F.col("expire_at") / 1000) if seconds else F.col("expire_at"), "expiretime")


def zpersist(z: DataFrame, request: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(key, member, done) of each request, and the members after."""
    alive = live(z, now)
    had = alive.where("expire_at IS NOT NULL").select("key", "member", F.lit(True).alias("_p"))
    reply = request.select("key", "member").join(had, ["key", "member"], "left").select("key", "member", F.col("_p").isNotNull().alias("done"))
    after = alive.join(request.select("key", "member", F.lit(True).alias("_p")).distinct(), ["key", "member"], "left")
    return reply, after.withColumn("expire_at", F.when(F.col("_p").isNull(), F.col("expire_at"))).drop("_p")


def zcollect(z: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """How many members of each key have expired, and the set without them."""
    return z.groupBy("key").agg(F.count_if(F.col("expire_at") <= now).alias("n")), live(z, now)
