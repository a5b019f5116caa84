"""Globs as anchored regular expressions, in the channel and the key dialect.

Channel globs: ``* ? [a-z] [^..] [!..]``, backslash escapes; an unclosed ``[`` is literal.
Key globs: only ``^`` negates, a range may be reversed, an unclosed ``[`` still is a set, and an
empty text matches the empty pattern only.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _members(body: str, keys: bool) -> str:
    """The inside of a set as a Java and Python character class."""
    out, i = [], 0
    while i < len(body):
        c = body[i]
        if c == "\\" and i + 1 < len(body):
            i += 1
            c = body[i]
        if i + 2 < len(body) and body[i + 1] == "-":
            a, b = c, body[i + 2]
            if a > b and keys:
                a, b = b, a
            out.append(f"{re.escape(a)}-{re.escape(b)}" if a <= b else "")
            i += 3
            continue
        out.append("\\" + c if c in r"\[]^-&~|" else re.escape(c))
        i += 1
    return "".join(out)


def glob_to_regex(pattern: str, *, keys: bool = False) -> str:
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < len(pattern):
            if not keys and pattern[i] == "x" and re.fullmatch(r"[0-9a-fA-F]{2}", pattern[i + 1 : i + 3]):
                out.append(re.escape(chr(int(pattern[i + 1 : i + 3], 16))))
                i += 3
            else:
                out.append(re.escape(pattern[i]))
                i += 1
        elif c == "[":
            end = i + (pattern[i : i + 1] in ("^", "!") if not keys else pattern[i : i + 1] == "^")
            while end < len(pattern) and pattern[end] != "]":
                end += 2 if pattern[end] == "\\" else 1
            if end >= len(pattern) and not keys:
                out.append(r"\[")
                continue
            body = pattern[i:end]
            negated = body[:1] == "^" or (not keys and body[:1] == "!")
            inside = _members(body[1:] if negated else body, keys)
            out.append(f"[{'^' if negated else ''}{inside}]" if inside else ("." if negated else "(?!)"))
            i = end + 1
        else:
            out.append(re.escape(c))
    body = "".join(out)
    return rf"(?s)\A(?=.){body}\z" if keys and pattern else rf"(?s)\A{body}\z"


def glob_prefix(pattern: str) -> str:
    """The literal start, for a predicate that a scan can push down."""
    return re.split(r"[*?\[\\]", pattern, maxsplit=1)[0]


def matches(text: Column, pattern: str, *, keys: bool = False) -> Column:
    start = glob_prefix(pattern)
    hit = text.rlike(glob_to_regex(pattern, keys=keys))
    return text.startswith(start) & hit if start else hit
