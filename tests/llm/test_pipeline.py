import os
import random
import re
import zlib
from array import array

import corpus_pipeline
import numpy as np
import public_tokenizers
from keyloom.llm import lang_id
from tokenizers import Tokenizer

LETTERS = {"aa": "abcdefghij", "bb": "nopqrstuvw"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randrange(4, 8))) for _ in range(n))


def language_share(model, text):
    """Plain forward passes, segment by segment, byte by byte."""
    raw = text.lower().encode()
    total = np.zeros(len(model.langs))
    hid = model.recur.shape[2]
    for lo in range(0, len(raw), lang_id.SEGMENT):
        x = np.frombuffer(raw[lo : lo + lang_id.SEGMENT], np.uint8)[:, None].astype(int)
        ahead = lang_id._forward(x, model.embed[0], model.recur[0], hid)
        back = lang_id._forward(x[::-1], model.embed[1], model.recur[1], hid)
        for t in range(len(x)):
            z = model.out[0] @ ahead[t + 1][0] + model.out[1] @ back[len(x) - t][0] + model.bias[:, None]
            e = np.exp(z[:, 0])
            total += e / e.sum()
    return total / len(raw)


def brute(rows, items, model):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1]) and language_share(model, r[1]).max() >= corpus_pipeline.MIN_LANG_SCORE]
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").lower()  # noqa: E731  the fixture is ASCII
    owner = {}
    for i, t in sorted(rows):
        for line in t.split("\n"):
            owner.setdefault(key(line), i)
    rows = [(i, "\n".join(s for s in t.split("\n") if len(key(s)) < 10 or owner[key(s)] == i)) for i, t in rows]
    rows = [r for r in rows if r[1].strip(" \t\n\x0b\x0c\r")]
    sets = {}
    for i, t in rows:
        w = t.lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    comp = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if comp[b] < comp[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b]
    rows = [r for r in rows if comp[r[0]] == r[0]]
    plain = lambda s: " " + re.sub(r"[\W_]+", " ", s.lower()).strip() + " "
    rows = [r for r in rows if not any(plain(x) in plain(r[1]) for _, x in items)]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [0]
        for k, lo in enumerate(range(0, len(ids), 2048)):
            part = ids[lo : lo + 2048]
            out.append((i, k, lo, len(part), zlib.crc32(array("I", part).tobytes())))
    return sorted(out)


def test_near_dedup_keeps_the_least_row_of_an_id(spark):
    rng = random.Random(4)
    a, b, c = (prose(rng, "aa", 40) for _ in range(3))
    rows = [(1, b, "x", "s", 1), (1, a, "x", "s", 1), (1, a, "w", "s", 1), (2, c, "x", "s", 1), (3, a, "x", "s", 1), (None, a, "x", "s", 1), (None, a, "x", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        got = corpus_pipeline.near_dedup(spark, docs.repartition(parts), "")
        least = min((t, lang) for i, t, lang, *_ in rows if i == 1)
        assert sorted(map(str, map(tuple, got.select("doc_id", "text", "lang").collect()))) == sorted(map(str, [(1, *least), (2, c, "x"), (None, a, "x"), (None, a, "x")]))


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    items = [(i, prose(rng, "aa", 15)) for i in range(4)]
    shared = [prose(rng, "bb", 6) for _ in range(3)]
    rows = []
    for i in range(80):
        lang = rng.choice(["aa", "bb"])
        lines = [prose(rng, lang, rng.randrange(5, 40)) for _ in range(rng.randrange(1, 4))]
        if i % 7 == 0:
            lines.insert(0, rng.choice(shared))
        if i % 11 == 0:
            lines[-1] += ". " + rng.choice(items)[1].upper() + "! " + prose(rng, lang, 3)
        rows.append((i, "\n".join(lines), lang))
    for i in range(80, 95):  # near copies on one line of their own
        w = rows[i - 80][1].replace("\n", " ").split()
        rows.append((i, " ".join([*w, "tail"]), "aa"))
    rows += [(95, None, "aa"), (96, "", "bb"), (97, "12 34 !", "aa"), (98, rows[1][1], "aa"), (99, prose(rng, "aa", 3000), "aa")]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = lang_id.learn_languages(spark.read.parquet(str(tmp_path / "documents.parquet")))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = brute([(i, t) for i, t, _ in rows], items, model)
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert 10 < len({w[0] for w in want}) < 90
    left = [f for f in os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:") + "/keyloom") if f.startswith("pipeline-")]
    assert left == []
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
