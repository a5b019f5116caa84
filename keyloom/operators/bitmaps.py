"""Bitmaps: rows (key, bit) for the bits that are 1; bit 0 is the highest bit of byte 0.

The length of a bitmap is a table of its own, (key, n_bytes), given where it matters and is more
than the ones need. Operations over several bitmaps take single-key frames of a ``bit`` column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def setbit(log: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """A log (key, bit, on, seq): the last write of each bit decides."""
    rows = log.select("key", "bit", F.struct(F.col("seq").cast("long").alias("seq"), F.col("on").cast("int").alias("on")).alias("w"))
    if bits is not None:
        rows = rows.union(bits.select("key", "bit", F.struct(F.lit(None).cast("long").alias("seq"), F.lit(1).alias("on")).alias("w")))
    return rows.groupBy("key", "bit").agg(F.max("w").alias("w")).where("w.on = 1").select("key", "bit")


def getbit(bits: DataFrame, request: DataFrame) -> DataFrame:
    return request.join(bits.withColumn("_on", F.lit(1)), ["key", "bit"], "left").select("key", "bit", F.coalesce("_on", F.lit(0)).alias("value"))


def setbit_replies(log: DataFrame, bits: DataFrame | None = None) -> DataFrame:
    """(key, bit, seq, old): the bit that each write of the log (key, bit, on, seq) replaced."""
    before = F.lag("on").over(Window.partitionBy("key", "bit").orderBy("seq"))
    rows = log.select("key", "bit", "seq", before.cast("int").alias("_w"))
    if bits is None:
        return rows.select("key", "bit", "seq", F.coalesce("_w", F.lit(0)).alias("old"))
    held = rows.join(bits.select("key", "bit", F.lit(1).alias("_b")), ["key", "bit"], "left")
    return held.select("key", "bit", "seq", F.coalesce("_w", "_b", F.lit(0)).alias("old"))


def bytes_of(bits: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(key, n_bytes): the length that the bits need, or a longer one that ``sizes`` (key, n_bytes) has;
    a bitmap may end in bytes of zeros, and one of zeros only is known by its size alone."""
    needed = bits.groupBy("key").agg((F.floor(F.max("bit") / 8) + 1).cast("long").alias("n_bytes"))
    return needed if sizes is None else needed.union(sizes.select("key", F.col("n_bytes").cast("long"))).groupBy("key").agg(F.max("n_bytes").alias("n_bytes"))


def bytes_written(log: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(key, n_bytes) after a log of SETBIT, which lengthens a bitmap even by writing a 0."""
    return bytes_of(log.select("key", "bit"), sizes)


def _within(bits: DataFrame, start: int, end: int, unit: str, sizes: DataFrame | None) -> DataFrame:
    """(key, _lo, _hi, _n): the first and last bit of a range of bytes or bits, and the length in bits."""
    width = {"BYTE": 8, "BIT": 1}[unit]
    n = bytes_of(bits, sizes).select("key", (F.col("n_bytes") * 8).alias("_n"))
    units = F.col("_n") / width
    place = lambda i: F.greatest(units + i, F.lit(0)) if i < 0 else F.lit(i)
    first, last = place(start), F.least(units - 1, units + end if end < 0 else F.lit(end))
    return n.select("key", (first * width).cast("long").alias("_lo"), ((last + 1) * width - 1).cast("long").alias("_hi"), "_n")


def bitcount(bits: DataFrame, start: int = 0, end: int = -1, *, unit: str = "BYTE", sizes: DataFrame | None = None) -> DataFrame:
    """Ones within an inclusive range of bytes, or of bits with ``unit`` BIT; keys without any are absent."""
    rows = bits
    if start or end != -1:
        rows = bits.join(_within(bits, start, end, unit, sizes), "key").where(F.col("bit").between(F.col("_lo"), F.col("_hi")))
    return rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def bitpos(bits: DataFrame, value: int, start: int = 0, end: int | None = None, *, unit: str = "BYTE", sizes: DataFrame | None = None) -> DataFrame:
    """The first 1 or 0 within an inclusive range of bytes, or of bits with ``unit`` BIT: for a 0 the
    first place whose rank among the ones of the range is not its own. -1 where there is none; but
    without an ``end`` a 0 is found after the last byte."""
    span = _within(bits, start, -1 if end is None else end, unit, sizes)
    inside = span.join(bits.select("key", "bit"), "key", "left").withColumn("bit", F.when(F.col("bit").between(F.col("_lo"), F.col("_hi")), F.col("bit")))
    if value:
        return inside.groupBy("key").agg(F.coalesce(F.min("bit"), F.lit(-1)).cast("long").alias("bit"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.col("bit").asc_nulls_last())) - 1 + F.col("_lo")
    gap = inside.withColumn("_r", rank).groupBy("key", "_lo", "_hi", "_n").agg(F.min(F.when(F.col("bit") != F.col("_r"), F.col("_r"))).alias("_gap"), F.count("bit").alias("_ones"))
    after = F.col("_lo") + F.col("_ones")
    found = F.coalesce("_gap", F.when(after <= F.col("_hi"), after), F.when(F.lit(end is None) & (F.col("_lo") <= F.col("_hi")), F.col("_n")), F.lit(-1))
    return gap.select("key", found.cast("long").alias("bit"))


#: Bytes in a block of places that one row stands for.
BLOCK_BYTES = 1 << 16


def _places(n_bytes: DataFrame) -> DataFrame:
    """Every bit of one bitmap of ``n_bytes``: its blocks are dealt to tasks before they are written out."""
    n = n_bytes.select(F.col("n_bytes").cast("long").alias("_m"))
    blocks = n.where("_m > 0").select("_m", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_m") - 1) / BLOCK_BYTES))).alias("_k")).repartition("_k")
    last = F.least(F.col("_m"), (F.col("_k") + 1) * BLOCK_BYTES) * 8 - 1
    return blocks.select(F.explode(F.sequence(F.col("_k") * (BLOCK_BYTES * 8), last)).alias("bit"))


def bitop(op: str, sources: list[DataFrame], n_bytes: DataFrame | None = None) -> DataFrame:
    """AND, OR, XOR, NOT (of one) or DIFF (the first without the others), as rows of bits. NOT covers
    the source's length: the one row of ``n_bytes``, or what its ones need. The result of every
    operation is as long as its longest source."""
    counted = lambda: reduce(DataFrame.union, [s.select("bit") for s in sources]).groupBy("bit").agg(F.count(F.lit(1)).alias("_n"))
    if op == "AND":
        return counted().where(F.col("_n") == len(sources)).select("bit")
    if op == "OR":
        return reduce(DataFrame.union, [s.select("bit") for s in sources]).distinct()
    if op == "XOR":
        return counted().where(F.col("_n") % 2 == 1).select("bit")
    if op == "NOT":
        (one,) = sources
        if n_bytes is None:
            n_bytes = one.agg((F.floor(F.max("bit") / 8) + 1).alias("n_bytes")).where("n_bytes IS NOT NULL")
        return _places(n_bytes).join(one.select("bit"), "bit", "left_anti")
    if op == "DIFF":
        return sources[0].select("bit").join(reduce(DataFrame.union, [s.select("bit") for s in sources[1:]]), "bit", "left_anti")
    raise ValueError(op)


def packed_sizes(df: DataFrame, raw: str = "value") -> DataFrame:
    """(key, n_bytes) of packed binary values."""
    return df.select("key", F.octet_length(F.col(raw)).cast("long").alias("n_bytes"))


def unpack(df: DataFrame, raw: str = "value") -> DataFrame:
    """(key, bit) from packed binary values."""
    hexed = df.select("key", F.hex(F.col(raw)).alias("_h"))
    digits = hexed.select("key", F.posexplode(F.split("_h", "")).alias("_p", "_d")).where("_d <> ''")
    each = digits.select("key", "_p", F.conv("_d", 16, 10).cast("int").alias("_v"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("_k"))
    return each.where(F.expr("(_v >> (3 - _k)) & 1 = 1")).select("key", (F.col("_p") * 4 + F.col("_k")).cast("long").alias("bit"))


def popcount(raw: Column) -> Column:
    return F.bitmap_count(raw)
