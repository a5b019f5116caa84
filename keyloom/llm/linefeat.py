"""Character and word counts of lines and texts, for many texts at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from keyloom.llm.text import at_blanks

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"

_KINDS = ["blank", "symbol", "pipe", "upper", "digit", "bang", "stop", "other_mark", "start"]
_IN = np.zeros((256, len(_KINDS)), np.int32)
for _c in b" \t\n\x0b\x0c\r":
    _IN[_c, 0] = 1
for _c in SYMBOLS.encode():
    _IN[_c, 1] = 1
_IN[ord("|"), 2] = 1
_IN[ord("A") : ord("Z") + 1, 3] = 1
_IN[ord("0") : ord("9") + 1, 4] = 1
_IN[ord("!"), 5] = 1
for _c in b".,;:?":
    _IN[_c, 6] = 1
for _c in b"\"'()-/=@[\\]^_`{}~+":
    _IN[_c, 7] = 1
_IN[:, 8] = 1
_IN[0x80:0xC0, 8] = 0  # every byte but those that continue a character
#: Bytes looked at in one go; a longer text is read in strides.
STRIDE = 1 << 19


@dataclass
class Lines:
    """counts: (lines, kinds) characters of each line without its \\n; doc: the text of each line."""

    counts: np.ndarray
    doc: np.ndarray
    words: np.ndarray
    repeated: np.ndarray  # a line with a word that equals an earlier line of its text
    last: np.ndarray  # the last byte that is not blank, or 0

    def share(self, kind: str) -> np.ndarray:
        return self.counts[:, _KINDS.index(kind)] / np.maximum(self.counts[:, 8] - self.counts[:, 0], 1)

    def of(self, kind: str) -> np.ndarray:
        return self.counts[:, _KINDS.index(kind)]


def _count(b: np.ndarray, n_lines: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character counts, words and last visible byte of the lines of ``b``, which ends with \n,
    ``STRIDE`` bytes at a time: a line may span many strides."""
    own, words, last = np.zeros((n_lines, len(_KINDS)), np.int64), np.zeros(n_lines, np.int64), np.zeros(n_lines, np.int64)
    line, after_blank = 0, True
    for lo in range(0, len(b), STRIDE):
        part = b[lo : lo + STRIDE]
        ends = np.flatnonzero(part == 10)
        if len(ends) == 0 or ends[-1] != len(part) - 1:
            ends = np.append(ends, len(part))  # the line goes on in the next stride
            closed = len(ends) - 1
        else:
            closed = len(ends)
        starts = np.concatenate([[0], ends[:-1] + 1])
        at = slice(line, line + len(ends))
        for k in range(len(_KINDS)):
            total = np.concatenate([[0], np.cumsum(_IN[part, k])])
            own[at, k] += total[ends] - total[starts]
        blank = _IN[part, 0].astype(bool)
        begin = ~blank & np.concatenate([[after_blank], blank[:-1]])
        total = np.concatenate([[0], np.cumsum(begin)])
        words[at] += total[ends] - total[starts]
        seen_at = np.concatenate([[0], np.maximum.accumulate(np.where(blank, 0, np.arange(1, len(part) + 1)))])
        place = seen_at[ends]  # one past the last byte that is not blank
        last[at] = np.where(place > starts, part[np.maximum(place - 1, 0)], last[at])
        line, after_blank = line + closed, bool(blank[-1])
    return own, words, last


def read_lines(texts: list[str]) -> Lines:
    """Lines of every text, split at \n; an empty text is one empty line."""
    raws = [t.encode("utf-8", "replace") for t in texts]
    counts, docs, words, repeated, last = [], [], [], [], []
    lo = 0
    while lo < len(raws):
        hi, size = lo, 0
        while hi < len(raws) and (hi == lo or size + len(raws[hi]) < STRIDE):
            size += len(raws[hi]) + 1
            hi += 1
        n_lines = [raw.count(b"\n") + 1 for raw in raws[lo:hi]]
        own, n_words, tail = _count(np.frombuffer(b"\n".join(raws[lo:hi]) + b"\n", np.uint8), sum(n_lines))
        counts.append(own)
        words.append(n_words)
        last.append(tail)
        docs.append(np.repeat(np.arange(lo, hi), n_lines))
        at = 0
        for i, n in zip(range(lo, hi), n_lines, strict=True):
            rep = np.zeros(n, bool)
            if n > 1:
                met: set[bytes] = set()
                for k, line in enumerate(raws[i].split(b"\n")):
                    if n_words[at + k]:
                        if line in met:
                            rep[k] = True
                        else:
                            met.add(line)
            repeated.append(rep)
            at += n
        lo = hi
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return Lines(np.concatenate(counts) if counts else np.zeros((0, len(_KINDS)), np.int64), cat(docs, np.int64), cat(words, np.int64), cat(repeated, bool), cat(last, np.int64))


def repeated_words(text: str) -> tuple[int, int]:
    """(words of ``text`` inside a 3-word window found twice or more, distinct words)."""
    number: dict[bytes, int] = {}
    a = np.concatenate([np.fromiter((number.setdefault(w, len(number)) for w in some), np.int64, len(some)) for some in map(bytes.split, at_blanks(text.encode("utf-8", "replace"), STRIDE))])  # bytes split at ASCII blanks only
    if len(a) < 4 or len(number) == len(a):
        return 0, len(number)
    m = len(number)
    pairs = a[:-1] * m + a[1:]
    if m >= 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    codes = pairs[:-1] * m + a[2:]
    s = np.sort(codes)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return 0, m
    hit = np.isin(codes, twice)
    inside = np.zeros(len(a), bool)
    for k in range(3):
        inside[k : k + len(hit)] |= hit
    return int(inside.sum()), m


def per_text(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n).astype(np.int64)
