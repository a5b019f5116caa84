"""52-bit geohash scores and great-circle distances as column expressions."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The sphere's radius in metres, units, and the letters of a printed geohash.
RADIUS = 6372797.560856
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
LETTERS = "0123456789bcdefghjkmnpqrstuvwxyz"
#: Bits of each coordinate in a score.
BITS = 26


def _spread(x: Column) -> Column:
    """Bit k of x moves to bit 2 k. Four bits at a time by products that bring each to its place without
    a carry, so every part of the sum is plain arithmetic on x."""
    four = lambda k: F.shiftrightunsigned(x, 4 * k).bitwiseAND(F.lit(0xF))
    wide = lambda v: F.shiftrightunsigned((v * 0x1111).bitwiseAND(F.lit(0x8421)) * 0x249, 9).bitwiseAND(F.lit(0x55))
    return reduce(add, [F.shiftleft(wide(four(k)), 8 * k) for k in range(-(-BITS // 4))])


def _gather(x: Column) -> Column:
    """Bit 2 k of x moves to bit k."""
    return reduce(add, [F.shiftleft(F.shiftrightunsigned(x, 2 * k).bitwiseAND(F.lit(1)), k) for k in range(BITS)])


def _cell(x: Column, span: float) -> Column:
    """Cell of a coordinate within -span .. span, of 2^26: the upper bits of one of 2^32."""
    return F.shiftrightunsigned(F.least(F.floor((x / (2 * span) + 0.5) * 4294967296.0), F.lit(4294967295)).cast("long"), 32 - BITS)


def geo_score(lon: Column, lat: Column) -> Column:
    """The 52-bit score as a double: latitude on even bits, longitude on odd ones."""
    return _spread(_cell(lat, 90.0)).bitwiseOR(F.shiftleft(_spread(_cell(lon, 180.0)), 1)).cast("double")


def geo_position(score: Column) -> tuple[Column, Column]:
    """Longitude and latitude of the cell's centre."""
    code = score.cast("long")
    half = lambda x, span: (x / float(1 << BITS) - 0.5) * (2 * span) + span / float(1 << BITS)
    return half(_gather(F.shiftrightunsigned(code, 1)), 180.0), half(_gather(code), 90.0)


def geo_text(score: Column) -> Column:
    """Eleven characters: ten from the 52 bits, and a constant 0."""
    code = score.cast("long")
    chars = [F.substring(F.lit(LETTERS), F.shiftrightunsigned(code, 47 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(10)]
    return F.concat(*chars, F.lit("0"))


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, unit: str = "m") -> Column:
    """Haversine distance."""
    square = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
    a = square(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * square(lon2 - lon1)
    return F.lit(2 * RADIUS) * F.asin(F.sqrt(F.when(a > 1.0, 1.0).otherwise(a))) / F.lit(UNITS[unit])


def _prefix(x: int, y: int, bits: int) -> int:
    out = 0
    for k in range(bits):
        out |= ((y >> k) & 1) << (2 * k) | ((x >> k) & 1) << (2 * k + 1)
    return out


def covering_ranges(lon: float, lat: float, d_lon: float, d_lat: float, most: int = 32) -> list[tuple[int, int]]:
    """Ranges of scores (first, last) that hold every place within ``d_lon`` and ``d_lat`` degrees: the
    cells of the finest grid of which ``most`` cover it, neighbouring ones joined. Longitudes wrap."""
    for bits in range(26, -1, -1):
        n = 1 << bits
        first = math.floor((lat - d_lat + 90) / 180 * n)
        ys = range(max(0, first), min(n - 1, math.floor((lat + d_lat + 90) / 180 * n)) + 1)
        if d_lon >= 180:
            xs = range(n)
        else:
            lo, hi = math.floor((lon - d_lon + 180) / 360 * n), math.floor((lon + d_lon + 180) / 360 * n)
            xs = range(lo, min(hi, lo + n - 1) + 1)
        if len(xs) * len(ys) <= most:
            break
    width = 1 << (52 - 2 * bits)
    out: list[list[int]] = []
    for p in sorted({_prefix(x % n, y, bits) for x in xs for y in ys}):
        if out and out[-1][1] == p * width - 1:
            out[-1][1] += width
        else:
            out.append([p * width, (p + 1) * width - 1])
    return [(lo, hi) for lo, hi in out]
