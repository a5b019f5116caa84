"""Token ids of whole texts, with the ids of repeated chunks remembered.

For tokenizers that drop white space and never match across it, the ids of a text are the ids of
its white-space-separated chunks in order. A chunk's ids come from the tokenizer itself; a bounded
table in each task remembers them, as bytes, so that a text's ids are one join.
"""

from __future__ import annotations

import os
import re
import unicodedata

import numpy as np

#: Entries remembered in a Python worker, about 220 bytes each; the table starts anew beyond it.
REMEMBERED = 600_000
#: Characters of the longest chunk that is remembered: text without blanks is one chunk of any size.
LONGEST = 128
#: Python splits at these, the tokenizer's expression does not: such texts go through it whole.
_ODD = re.compile(r"[\x1c-\x1f]")
_MARKS = ".,!?;:"
_END = "</w>"
_SHARED: dict[str, ChunkTokenizer] = {}


class ChunkTokenizer:
    """Ids as little-endian unsigned 32-bit bytes. Strings of special tokens are ordinary text."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(_END)]] = True

    @classmethod
    def shared(cls, path: str) -> ChunkTokenizer:
        """One for each file in a Python worker, so that later tasks start with what earlier ones learned."""
        if path not in _SHARED:
            _SHARED[path] = cls(path)
        return _SHARED[path]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters only: each is one run of ids, closed by an id that ends a word."""
        if not words:
            return []
        buf = self._encode([" ".join(words)])[0]
        stops = 4 * (np.flatnonzero(self.ends[np.frombuffer(buf, "<u4")]) + 1)
        if len(stops) != len(words):
            return self._encode(words)
        stops = stops.tolist()
        return [buf[lo:hi] for lo, hi in zip([0, *stops], stops)]  # noqa: B905  one stop more

    def _learn(self, chunks: set[str]) -> None:
        """Marks that follow a word are a run of their own, so "word." is "word" and "."."""
        known = self.known
        if len(known) + 2 * len(chunks) > self.remembered:
            known.clear()
        words, others, marked = set(), [], []
        for c in chunks:
            core = c if c.isalpha() else c.rstrip(_MARKS)
            if not core.isalpha():
                others.append(c)
                continue
            if core not in known:
                words.add(core)
            if core is not c:
                marked.append((c, core, c[len(core) :]))
        new = list(words)
        known.update(zip(new, self._encode_words(new), strict=True))
        others += {m for _, _, m in marked if m not in known}
        known.update(zip(others, self._encode(others), strict=True))
        for c, core, marks in marked:
            known[c] = known[core] + known[marks]

    def many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        split: list[list[str] | None] = []
        for text in texts:
            if _ODD.search(text):
                split.append(None)
                continue
            if not text.isascii():
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower-cased letter by letter
            split.append(text.lower().split())
        own = [c for c in split if c is not None]
        new = set().union(*own).difference(self.known)
        if new:
            if len(self.known) + 2 * len(new) > self.remembered:
                new = set().union(*own)
            self._learn(new)
        get = self.known.__getitem__
        out = [self._encode([text])[0] if chunks is None else b"".join(map(get, chunks)) for text, chunks in zip(texts, split, strict=True)]
        for chunk in new:
            if len(chunk) > LONGEST:
                self.known.pop(chunk, None)
                self.known.pop(chunk.rstrip(_MARKS), None)
        return out

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]
