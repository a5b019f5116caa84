"""Index, score and member ranges as predicates.

Inclusive index ranges count negative places from the end. Score bounds are numbers, or text with
"(" for an open end and "inf", "+inf", "-inf"; member bounds are "-", "+", "[x" or "(x".
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def norm_range(length: Column, start: int, stop: int) -> tuple[Column, Column]:
    """First and last index, clamped; empty where the first is greater."""
    place = lambda i: length + i if i < 0 else F.lit(i)
    return F.greatest(F.lit(0), place(start)), F.least(length - 1, place(stop))


def index_range(df: DataFrame, by: list[str], order: list[Column], backward: list[Column], start: int, stop: int) -> DataFrame:
    """Rows of each group within an inclusive index range of ``order``; ``backward`` is its reverse.

    A range counted from one end only is a row-number limit, which Spark applies before the
    shuffle too; only a range counted from both ends needs the group's size.
    """
    ahead, back = (F.row_number().over(Window.partitionBy(*by).orderBy(*o)) for o in (order, backward))
    if start >= 0 and stop >= 0:
        return df.withColumn("_i", ahead).where((F.col("_i") <= stop + 1) & (F.col("_i") > start)).drop("_i")
    if start < 0 and stop < 0:
        return df.withColumn("_i", back).where((F.col("_i") <= -start) & (F.col("_i") >= -stop)).drop("_i")
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    lo, hi = norm_range(F.col("_n"), start, stop)
    return df.withColumns({"_i": ahead - 1, "_n": size}).where((F.col("_i") >= lo) & (F.col("_i") <= hi)).drop("_i", "_n")


def drawn(df: DataFrame, element: str, n: int, seed: int) -> DataFrame:
    """``n`` seeded draws with repeats from the rows of every key, by their rank in order of ``element``."""
    size = df.groupBy("key").agg(F.count(F.lit(1)).alias("_size"))
    draws = size.select("key", "_size", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    draws = draws.select("key", "draw", F.pmod(F.xxhash64(F.lit(seed), "key", "draw"), F.col("_size")).cast("long").alias("_rank"))
    ranked = df.withColumn("_rank", (F.row_number().over(Window.partitionBy("key").orderBy(element)) - 1).cast("long"))
    return draws.join(ranked, ["key", "_rank"]).drop("_rank", "draw")


def _bound(x: float | str) -> tuple[float, bool]:
    text = str(x)
    is_open = text.startswith("(")
    value = float(text[1:] if is_open else text)
    return value, is_open


def score_within(score: Column, low: float | str, high: float | str) -> Column:
    """Nothing lies within NaN bounds, or when the low one is above the high one."""
    (a, open_a), (b, open_b) = _bound(low), _bound(high)
    if math.isnan(a) or math.isnan(b) or a > b or (a == b and (open_a or open_b)):
        return F.lit(False)
    out = F.lit(True)
    if a != -math.inf or open_a:
        out = (score > a) if open_a else (score >= a)
    if b != math.inf or open_b:
        out = out & ((score < b) if open_b else (score <= b))
    return out & ~F.isnan(score)


def lex_within(member: Column, low: str, high: str) -> Column:
    """Byte order of members; "-" and "+" are without bound, and every other bound begins with [ or (."""
    if not all(b in ("-", "+") or b[:1] in ("[", "(") for b in (low, high)):
        raise ValueError("min or max not valid string range item")
    out = F.lit(True)
    if low == "+" or high == "-":
        return F.lit(False)
    if low != "-":
        out = member > low[1:] if low[0] == "(" else member >= low[1:]
    if high != "+":
        out = out & (member < high[1:] if high[0] == "(" else member <= high[1:])
    return out
