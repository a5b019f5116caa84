"""Blocking pops, as a batch: requests and items of a key meet in order of time, folded in a sorted
stream, so that a key with very many of them is a stream and not a group in memory."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blpop(requests: DataFrame, arrivals: DataFrame, timeout: int) -> DataFrame:
    """requests (key, req, at) and arrivals (key, item, at), FIFO: item and wait of each request.

    Of what happens at one time items come first, each kind in order of its ids. A request takes the
    first item there is. Where there is none it waits, and an item goes to the first who still waits:
    one for whom it comes later than ``timeout`` after the request (0: never too late) has been
    answered with nothing by then and takes no item.
    """
    kinds = {c: df.schema[c].dataType for df, c in ((requests, "key"), (requests, "req"), (arrivals, "item"))}
    nth = lambda df, c: df.withColumn("seq", F.row_number().over(Window.partitionBy("key").orderBy("at", c)))
    got = _pops(nth(requests, "req"), nth(arrivals, "item"), timeout, False, False, items_first=True)
    return got.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()], "wait")


class _Waiting:
    """The items of one key, in order, and those who wait for one."""

    def __init__(self, timeout: int, last: bool, scored: bool) -> None:
        self.timeout, self.last, self.scored = timeout, last, scored
        self.items: list[tuple] = []
        self.score: dict = {}
        self.waiters: deque = deque()
        self.came = 0

    def push(self, item: str, score: float, at: int) -> Iterator[tuple]:
        while self.waiters and self.timeout and at > self.waiters[0][1] + self.timeout:
            yield self.waiters.popleft()[0], None, None, None
        if self.waiters:  # no items are left while one waits
            req, asked = self.waiters.popleft()
            yield req, item, score if self.scored else None, at - asked
            return
        if self.scored and item in self.score:
            del self.items[bisect_left(self.items, (self.score[item], item))]
        self.came += 1
        self.score[item] = score
        insort(self.items, (score, item) if self.scored else (self.came, item))

    def pop(self, req: str, n: int, at: int) -> Iterator[tuple]:
        if not self.items:
            self.waiters.append((req, at))
        for _ in range(min(n, len(self.items))):
            score, item = self.items.pop(-1 if self.last else 0)
            if self.scored:
                del self.score[item]
            yield req, item, score if self.scored else None, 0

    def rest(self) -> Iterator[tuple]:
        yield from ((req, None, None, None) for req, _ in self.waiters)


def _pops(requests: DataFrame, arrivals: DataFrame, timeout: int, last: bool, scored: bool, items_first: bool = False) -> DataFrame:
    text = lambda c: F.col(c).cast("string").alias(c)
    came = arrivals.select(text("key"), F.col("at").cast("long").alias("at"), F.lit(0).alias("kind"), text("item"), (F.col("score").cast("double") if scored else F.lit(0.0)).alias("score"), F.lit(0).alias("n"), F.col("seq").cast("long").alias("seq"))
    n = F.col("n").cast("int") if "n" in requests.columns else F.lit(1)
    asked = requests.select(text("key"), F.col("at").cast("long").alias("at"), F.lit(1).alias("kind"), text("req"), F.lit(0.0).alias("score"), n.alias("n"), F.col("seq").cast("long").alias("seq"))
    rows = came.union(asked).repartition("key").sortWithinPartitions("key", "at", *(("kind", "seq") if items_first else ("seq", "kind")))

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, _Waiting(timeout, last, scored)
        for batch in batches:
            out = []
            for key, at, kind, what, score, n in batch[["key", "at", "kind", "item", "score", "n"]].itertuples(index=False, name=None):
                if key != now:
                    out += [(now, *x) for x in state.rest()]
                    now, state = key, _Waiting(timeout, last, scored)
                out += [(key, *x) for x in (state.pop(what, n, at) if kind else state.push(what, score, at))]
            yield _frame(out)
        yield _frame([(now, *x) for x in state.rest()])

    return rows.mapInPandas(fold, "key string, req string, item string, score double, wait long")


def _frame(out: list[tuple]) -> pd.DataFrame:
    cols = list(zip(*out, strict=True)) or [()] * 5
    kinds = (object, object, object, "Float64", "Int64")
    return pd.DataFrame({c: pd.Series(list(x), dtype=t) for c, x, t in zip(("key", "req", "item", "score", "wait"), cols, kinds, strict=True)})


def bzpop(requests: DataFrame, arrivals: DataFrame, timeout: int, *, largest: bool = False) -> DataFrame:
    """BZPOPMIN, BZPOPMAX and BZMPOP on one key: requests (key, req, at, seq, and n for more than one
    member) and arrivals (key, item, score, at, seq), taken in order of at and seq.

    A request takes the lowest, or highest, members that are there; one that finds none waits for the
    next to come, first come first served, and is answered with nulls when that takes longer than
    ``timeout`` (0: never too late). A member that comes again has its new score.
    """
    return _pops(requests, arrivals, timeout, largest, True)


def blmpop(requests: DataFrame, arrivals: DataFrame, timeout: int, *, right: bool = False) -> DataFrame:
    """BLMPOP on one key, in the manner of ``bzpop``: arrivals (key, item, at, seq) go to the right end,
    and a request takes up to n items from the left end or the right."""
    return _pops(requests, arrivals, timeout, right, False).drop("score")


def blmove(requests: DataFrame, arrivals: DataFrame, timeout: int, *, take_right: bool = False, put_right: bool = False) -> tuple[DataFrame, DataFrame]:
    """BLMOVE, and BRPOPLPUSH with ``take_right``: requests also have ``dest``. The answers
    (key, req, dest, item, wait), and the log of pushes (key, seq, side, value) that ``lists.push`` takes."""
    got = blmpop(requests.drop("n"), arrivals, timeout, right=take_right)
    own = requests.select(F.col("key").cast("string").alias("key"), F.col("req").cast("string").alias("req"), "dest", "at", F.col("seq").alias("_s"))
    moved = got.join(own, ["key", "req"])
    order = F.row_number().over(Window.partitionBy("dest").orderBy(F.col("at") + F.col("wait"), "_s"))
    pushes = moved.where("item IS NOT NULL").select(F.col("dest").alias("key"), order.cast("long").alias("seq"), F.lit("R" if put_right else "L").alias("side"), F.col("item").alias("value"))
    return moved.select("key", "req", "dest", "item", "wait"), pushes
