import random
import zlib
from array import array

import public_tokenizers
import pytest
from keyloom.llm.packing import pack_documents, plan_fillings
from keyloom.llm.tokens import ChunkTokenizer
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(text):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    return tok.encode(text, add_special_tokens=False).ids


def test_chunk_tokenizer_equals_whole_text():
    rng = random.Random(5)
    alphabet = "abcXYZ019'st.,!?;:-éÉΣσİß é中文\t\n\x1d²  <|endoftext|>"
    tok = ChunkTokenizer(PATH, remembered=50)
    for _ in range(400):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(60)))
        assert list(array("I", tok.ids(text))) == plain_ids(text), repr(text)
    assert list(array("I", tok.ids("a <|endoftext|> b"))) == plain_ids("a <|endoftext|> b")


@pytest.mark.parametrize("seed", range(5))
def test_fillings_use_every_piece_once(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 64, 300])
    hist = {x: rng.randrange(1, 40) for x in rng.sample(range(1, cap + 1), min(cap, 40))}
    used = {}
    fillings = plan_fillings(hist, cap)
    for items, times in fillings:
        assert sum(items) <= cap and times > 0
        for x in items:
            used[x] = used.get(x, 0) + times
    assert used == hist
    total = sum(k * v for k, v in hist.items())
    assert sum(t for _, t in fillings) <= 2 * -(-total // cap)


def test_exact_complements_fill_sequences():
    assert sum(t for _, t in plan_fillings({60: 10, 30: 10, 10: 10}, 100)) == 10
    assert sum(t for _, t in plan_fillings({50: 8, 30: 8, 20: 8}, 100)) == 8
    assert plan_fillings({}, 100) == []


def test_pack_documents_brute_force(spark):
    rng = random.Random(2)
    words = ["alpha", "beta,", "Gamma.", "delta!!", "été", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "word " * 500), (3, rows[3][1]), (None, "alpha")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS piece", "2 AS length")
    cap = 64
    got = pack_documents(docs, PATH, capacity=cap).collect()
    want = []
    for i, text in rows:
        ids = plain_ids(text or "") + [0]
        for k, lo in enumerate(range(0, len(ids), cap)):
            part = ids[lo : lo + cap]
            want.append((i, k, lo, len(part), zlib.crc32(array("I", part).tobytes())))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(map(key, (r[:5] for r in got))) == sorted(map(key, want))
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= cap
    assert len(seqs) <= 1.1 * sum(r.length for r in got) / cap + 1


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
