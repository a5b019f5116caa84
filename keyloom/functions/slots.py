"""Hash slots: CRC-16 (polynomial 0x1021) of a key, or of its {tag}, modulo 16384."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_tag(key: Column) -> Column:
    """What stands between the first { and the first } after it, unless that is nothing."""
    tag = F.regexp_extract(key, r"(?s)^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def _table() -> list[int]:
    """The CRC of each byte value."""
    out = []
    for b in range(256):
        crc = b << 8
        for _ in range(8):
            crc = ((crc << 1) ^ (0x1021 if crc & 0x8000 else 0)) & 0xFFFF
        out.append(crc)
    return out


def key_slot(key: Column) -> Column:
    digits = F.hex(F.encode(hash_tag(key), "UTF-8"))
    places = F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2))
    table = F.array(*[F.lit(x) for x in _table()])
    byte = lambda p: F.conv(F.substr(digits, p, F.lit(2)), 16, 10).cast("int")

    def step(crc: Column, p: Column) -> Column:
        at = F.shiftrightunsigned(crc, 8).bitwiseXOR(byte(p)).bitwiseAND(F.lit(255))
        return F.shiftleft(crc, 8).bitwiseXOR(F.get(table, at)).bitwiseAND(F.lit(0xFFFF))

    crc = F.aggregate(places, F.lit(0), step)
    return F.when(F.length(digits) == 0, F.lit(0)).otherwise(crc) % 16384
