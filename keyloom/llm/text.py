"""Column expressions and small helpers that several operators share."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The blanks that separate words and are stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
ASCII_LOWER = str.maketrans(UPPER, LOWER)


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z; every other character stays."""
    return F.translate(c, UPPER, LOWER)


def strip_blanks(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def fold(c: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``: the split of labelled rows."""
    return F.crc32(c.cast("string").cast("binary")) % folds


def at_blanks(raw: bytes, size: int) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes that end where a word does."""
    lo = 0
    while len(raw) - lo > 2 * size:
        blank = _BLANK.search(raw, lo + size)
        if not blank:
            break
        yield raw[lo : blank.start()]
        lo = blank.start()
    yield raw[lo:]


def text_groups(column: pa.Array, rows: int = 400, chars: int = 1 << 21) -> Iterator[list[str]]:
    """The texts of a batch in turn, nulls as empty: at most ``rows`` at a time, and no more once they
    have ``chars`` characters, so that long texts do not pile up."""
    out, size = [], 0
    for text in column:
        out.append(text.as_py() or "")
        size += len(out[-1])
        if len(out) >= rows or size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out
