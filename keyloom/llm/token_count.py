"""Token counts: the number of pieces a unigram tokenizer gives, without making the pieces.

The vocabulary is a list of (piece, score); an Aho-Corasick automaton finds every vocabulary piece
in a word and dynamic programming carries, for each end, the best score and its number of pieces.
Ties go as in the tokenizer: among equal scores the piece that begins first, the longest, wins, a
character that no piece covers costs the lowest score less 10, and neighbouring unknown characters
are one unknown piece. A space becomes a mark at the front of the next word, so words are counted
apart, and a word's count is remembered in the Python worker. A text without spaces is one word; a
long one is counted in memory bounded by the longest piece.

The vocabulary of the query is that of a merge-rank tokenizer (the pieces of ``piece_bpe_32k.model``
with their scores, less the rank), taken as a unigram model: the counts are those of a unigram
tokenizer over it and not those of the file's own algorithm, which merges pairs.

A null text counts 0, as an empty one does. Each row gets its row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keyloom.sources import read_table

#: Words remembered in a Python worker.
REMEMBERED = 500_000
#: Characters of the longest word that is remembered, and of the longest whose ends are all kept.
LONGEST, IN_RING = 128, 4096
MARK = "▁"
UNKNOWN_PENALTY = 10.0
_LEAST = float("-inf")
_SHARED: dict[tuple, PieceCounter] = {}


def piece_vocabulary(model_path: str) -> list[tuple[str, float]]:
    """The pieces of a sentencepiece model file with their scores, control and byte pieces left out."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]


class PieceCounter:
    def __init__(self, vocabulary: list[tuple[str, float]], remembered: int = REMEMBERED):
        import ahocorasick

        self.auto = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()
        #: With every character of a word among these, nothing is unknown.
        self.longest = max((len(p) for p, _ in vocabulary), default=1)
        self.single = {p for p, _ in vocabulary if len(p) == 1}
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_PENALTY
        self.remembered = remembered
        self.known: dict[str, int] = {}

    @classmethod
    def shared(cls, key: str) -> PieceCounter:
        if key not in _SHARED:
            _SHARED[key] = cls(piece_vocabulary(key))
        return _SHARED[key]

    def count_word(self, word: str) -> int:
        """Pieces of ``word`` as it stands. The automaton gives matches by their end, the longest first."""
        n = len(word)
        if n > IN_RING or not self.single.issuperset(word):
            return self._count_in_ring(word)
        best, count = [_LEAST] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for last, (length, score) in self.auto.iter(word):
            at = last + 1 - length
            s = best[at] + score
            if s > best[last + 1]:
                best[last + 1] = s
                count[last + 1] = count[at] + 1
        return count[n]

    def _count_in_ring(self, word: str) -> int:
        """The same with unknown characters, or for a long word: of the ends behind, as many are kept as
        the longest piece reaches back."""
        size = self.longest + 1
        best, count, unknown = [_LEAST] * size, [0] * size, [False] * size
        best[0] = 0.0
        matches = iter(self.auto.iter(word) if len(self.auto) else ())
        match = next(matches, None)
        for e in range(1, len(word) + 1):
            top, pieces, odd = _LEAST, 0, False
            while match and match[0] + 1 == e:
                length, score = match[1]
                at = (e - length) % size
                if best[at] + score > top:
                    top, pieces = best[at] + score, count[at] + 1
                match = next(matches, None)
            at = (e - 1) % size
            if word[e - 1] not in self.single and best[at] + self.unknown > top:
                top, pieces, odd = best[at] + self.unknown, count[at] + (not unknown[at]), True
            best[e % size], count[e % size], unknown[e % size] = top, pieces, odd
        return count[len(word) % size]

    def many(self, texts: list[str]) -> list[int]:
        split = [[MARK + w for w in (t if t[0] != " " else t[1:]).split(" ")] if t else [] for t in (t.replace(MARK, " ") for t in texts)]
        new = set().union(*split).difference(self.known)
        if new:
            if len(self.known) + len(new) > self.remembered:
                self.known.clear()
                new = set().union(*split)
            count = self.count_word
            self.known.update((w, count(w)) for w in new)
        get = self.known.__getitem__
        out = [sum(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del self.known[w]
        return out


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, n_chars long) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter.shared(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 50):
                part = batch.slice(lo, 50)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counter.many(texts), pa.int64()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, "n_tokens", "n_chars"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, n_chars long")


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_token_count": op5_token_count}
