"""Long texts and words: the same results, and nothing long is remembered."""

import random
import zlib
from array import array

import public_tokenizers
import pytest
from keyloom.llm import near_dedup, packing, text, token_count, tokens
from tokenizers import Tokenizer, models, pre_tokenizers


def test_parts_end_at_blanks():
    rng = random.Random(1)
    for _ in range(200):
        raw = bytes(rng.choice(b"abc \t\n") for _ in range(rng.randrange(0, 200)))
        parts = list(text.at_blanks(raw, rng.randrange(1, 30)))
        assert b"".join(parts) == raw and sum((p.split() for p in parts), []) == raw.split()


def test_shingles_of_parts_are_those_of_the_whole(monkeypatch):
    rng = random.Random(2)
    t = " ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 30))) for _ in range(4000))
    whole = near_dedup.Shingler(5).hashes(t).tolist()
    monkeypatch.setattr(near_dedup.Shingler, "STRIDE", 8)
    assert near_dedup.Shingler(5).hashes(t).tolist() == whole and near_dedup.Shingler(5).hashes("").tolist() == []


@pytest.mark.parametrize("ring", [0, 6])
def test_long_words_are_counted_in_a_ring(monkeypatch, ring):
    monkeypatch.setattr(token_count, "IN_RING", ring)
    monkeypatch.setattr(token_count, "LONGEST", 5)
    rng = random.Random(3)
    for _ in range(40):
        vocab = list({"".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 5))): float(-rng.randrange(1, 4)) for _ in range(14)}.items())
        tok = Tokenizer(models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False))
        tok.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_count.PieceCounter(vocab)
        for _ in range(12):
            s = "".join(rng.choice("abab ▁é") for _ in range(rng.randrange(0, 40)))
            assert counter.many([s, s]) == [len(tok.encode(s, add_special_tokens=False).ids)] * 2, (vocab, s)
        assert all(len(w) <= 5 for w in counter.known)


def test_counts_of_a_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rng = random.Random(4)
    texts = [None, "", " ", "two words", "two words", "é" * 300, "x" * 20_000, " ".join("".join(rng.choice("etaoin") for _ in range(6)) for _ in range(5000))]
    rows = [(i if i != 4 else 3, t) for i, t in enumerate(texts)] + [(None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS n_chars")
    counter = token_count.PieceCounter(token_count.piece_vocabulary(path))
    want = []
    for i, t in rows:
        words = ["▁" + w for w in (t[1:] if t[:1] == " " else t).split(" ")] if t else []
        want.append((str(i), sum(map(counter._count_in_ring, words)), len(t or "")))
    assert sorted((str(r.doc_id), r.n_tokens, r.n_chars) for r in token_count.count_tokens(docs, path).collect()) == sorted(want)
    assert token_count.count_tokens(docs.limit(0), path).count() == 0


def test_long_chunks_are_not_remembered():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, plain = tokens.ChunkTokenizer(path), Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for t in ("ab" * 500 + "..", "word " + "漢字" * 400 + " word", "x" * 300 + " " + "x" * 300 + ". end"):
        for _ in range(2):
            assert list(array("I", tok.ids(t))) == plain.encode(t, add_special_tokens=False).ids
    assert max(map(len, tok.known)) <= tokens.LONGEST


def test_one_very_long_text_is_packed(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    t = "lorem ipsum dolor, " * 30_000 + "z" * 50_000
    got = packing.pack_documents(spark.createDataFrame([(1, t), (2, "a b")], "doc_id long, text string"), path).orderBy("doc_id", "piece").collect()
    ids = plain.encode(t, add_special_tokens=False).ids + [0]
    parts = [ids[lo : lo + 2048] for lo in range(0, len(ids), 2048)]
    assert [(r.piece, r.length, r.ids_crc32) for r in got if r.doc_id == 1] == [(k, len(p), zlib.crc32(array("I", p).tobytes())) for k, p in enumerate(parts)]
    assert len({r.sequence_id for r in got}) == len(parts)
