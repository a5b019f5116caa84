"""Approximate distinct counts: sketches with 2^14 registers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOG2_REGISTERS = 14


def pfadd(elems: DataFrame) -> DataFrame:
    """(key, elem) to (key, sketch)."""
    return elems.groupBy("key").agg(F.hll_sketch_agg("elem", F.lit(LOG2_REGISTERS)).alias("sketch"))


def pfcount(sketches: DataFrame) -> DataFrame:
    return sketches.select("key", F.hll_sketch_estimate("sketch").alias("n"))


def pfmerge(sketches: DataFrame) -> DataFrame:
    """One sketch of all keys, and its count."""
    return sketches.agg(F.hll_union_agg("sketch").alias("sketch"))


def registers(elems: DataFrame) -> DataFrame:
    """(key, idx, rank): the registers as rows; the low 14 bits of a 64-bit hash choose one, the
    zeros above them make its rank. A merge is the largest rank of each register."""
    h = F.xxhash64("elem")
    rest = F.shiftrightunsigned(h, LOG2_REGISTERS)
    rank = F.least(F.lit(64 - LOG2_REGISTERS + 1), F.lit(64 - LOG2_REGISTERS + 1) - F.when(rest == 0, 0).otherwise(F.length(F.bin(rest))))
    return elems.select("key", h.bitwiseAND(F.lit((1 << LOG2_REGISTERS) - 1)).alias("idx"), rank.alias("rank")).groupBy("key", "idx").agg(F.max("rank").alias("rank"))


def merged(regs: DataFrame) -> DataFrame:
    """(idx, rank) of the union of all keys."""
    return regs.groupBy("idx").agg(F.max("rank").alias("rank"))


def changed(regs: DataFrame, elems: DataFrame) -> DataFrame:
    """(key, changed): whether PFADD of ``elems`` (key, elem) raises any register."""
    new = registers(elems).join(regs.withColumnRenamed("rank", "_was"), ["key", "idx"], "left")
    return new.groupBy("key").agg(F.max(F.col("rank") > F.coalesce("_was", F.lit(0))).cast("int").alias("changed"))


def _empty_part(x: Column) -> Column:
    """x + the sum of x^(2^k) 2^(k - 1): what the share x of empty registers adds. x is 1 - 1 / m at
    most, so its powers vanish long before the last term."""
    return sum((F.pow(x, F.lit(float(1 << k))) * float(1 << (k - 1)) for k in range(1, LOG2_REGISTERS + 10)), x)


def _full_part(x: Column) -> Column:
    """What the share 1 - x of registers at the highest rank adds."""
    terms = (F.pow(1 - F.pow(x, F.lit(2.0**-k)), F.lit(2.0)) * 2.0**-k for k in range(1, 50))
    return F.when((x <= 0) | (x >= 1), 0.0).otherwise((1 - x - sum(terms)) / 3)


def estimate(regs: DataFrame) -> DataFrame:
    """(key, n) by the estimator from the histogram of the registers, which needs no switch between
    small and large counts (Ertl, arXiv:1702.01284)."""
    m, q = float(1 << LOG2_REGISTERS), 64 - LOG2_REGISTERS
    s = regs.groupBy("key").agg(F.sum(F.when(F.col("rank") <= q, F.pow(F.lit(2.0), -F.col("rank")))).alias("s"), F.count_if(F.col("rank") > q).alias("top"), F.count(F.lit(1)).alias("used"))
    z = F.coalesce("s", F.lit(0.0)) + _full_part(1 - F.col("top") / m) * (m * 2.0**-q) + _empty_part(1 - F.col("used") / m) * m
    return s.select("key", F.round(F.lit(m * m / (2 * math.log(2))) / z).cast("long").alias("n"))
