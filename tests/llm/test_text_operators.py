import random
import re
import zlib

import pytest
from keyloom.llm import lang_id, licence_scan, line_dedup, linefeat, near_dedup, quality_crf, quality_rank, token_count, url_filter
from keyloom.llm.components import connected_components
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYLLABLES = ["ka", "lo", "mi", "ner", "tu", "sha", "pe", "ron"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randrange(2, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def docs_frame(spark, rows):
    """Documents with columns whose names clash with those of the operators."""
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS kept", "1 AS score", "2 AS n_lines")


def test_line_dedup_brute_force(spark):
    rng = random.Random(1)
    pool = [prose(rng, 4) for _ in range(12)] + ["short", "", "  Padded Line Here\t", "padded line here"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 8)))) for i in range(40)]
    rows += [(40, None), (41, ""), (42, "\n\n"), (3, rows[3][1]), (None, rows[5][1])]
    rank = lambda i: float("inf") if i is None else i
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for min_docs in (2, 3):
        held = {}
        for i, t in rows:
            for s in (t or "").split("\n"):
                held.setdefault(key(s), set()).add(rank(i))
        want = []
        for i, t in rows:
            lines = (t or "").split("\n")
            keep = [s for s in lines if not (len(key(s)) >= 10 and len(held[key(s)]) >= min_docs and rank(i) != min(held[key(s)]))]
            want.append((rank(i), len(lines), len(lines) - len(keep), "\n".join(keep)))
        got = line_dedup.dedup_lines(docs_frame(spark, rows), min_docs=min_docs)
        assert sorted((rank(r.doc_id), r.n_lines, r.n_dropped, r.text) for r in got.collect()) == sorted(want)
    assert line_dedup.dedup_lines(docs_frame(spark, rows).limit(0)).count() == 0


def test_url_rules(spark):
    urls = ["https://a.example.org/es/1", "http://EXAMPLE.org/en/15?x", "http://example.org/en/2", "http://x.org", "https://m.casino-win.example.com/en/1", "https://b.com/de/", "https://b.com/fr/casino", "https://casino.io/", "nothing", None, "http://notexample.org.evil.net/es/", "https://b.com/fr/", "https://b.com/fr/"]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "'c' AS rule", "1 AS token")
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in url_filter.filter_urls(pages, url_filter.LISTED + url_filter.PATTERNS).collect()}
    assert got[0] == ("a.example.org", "example.org/es/", "block")
    assert got[1] == ("example.org", "example.org/en/1", "block") and got[2][1:] == ("org/", "allow")
    assert got[3] == ("x.org", None, "allow") and got[4][1:] == (None, "block")
    assert got[5][1:] == ("com/de/", "block") and got[6][1:] == ("com/fr/", "allow") and got[7][1:] == (None, "block")
    assert got[8] == got[9] == ("", None, "allow") and got[10][1:] == (None, "allow") and got[11] == got[12]
    assert url_filter.filter_urls(pages.limit(0), url_filter.LISTED).count() == 0


def near_rows(rng):
    base = [prose(rng, 60).split() for _ in range(5)]
    rows = []
    for i in range(60):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(len(w))] = word(rng)
        rows.append((i, " ".join(w)))
    return rows + [(60, None), (61, ""), (62, "One two"), (63, "one  TWO"), (64, " \t"), (None, "one two"), (5, rows[5][1])]


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates_brute_force(spark, size):
    rng = random.Random(size)
    rows = near_rows(rng)
    sets = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < size else (tuple(w[k : k + size]) for k in range(len(w) - size + 1)))
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a in ids:
            for b in ids:
                if comp[b] < comp[a] and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a], changed = comp[b], True
    got = near_dedup.near_duplicates(docs_frame(spark, rows), size=size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (comp[r.doc_id], comp[r.doc_id] == r.doc_id), r
    assert any(comp[i] != i for i in ids)


def test_near_duplicates_empty(spark):
    assert near_dedup.near_duplicates(docs_frame(spark, [(1, "a")]).limit(0)).count() == 0


def test_pruning_bound_and_components(spark):
    for n in (32, 100):
        m = near_dedup.least_matches(n, 80, 1e-4)
        assert 0 < m < 0.8 * n
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (50, 50)], "a long, b long")
    got = {r.id: r.label for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[101] == 100


def test_token_counts_equal_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(4)
    for _ in range(60):
        vocab = {}
        for _ in range(12):
            vocab["".join(rng.choice("ab▁") for _ in range(rng.randrange(1, 4)))] = float(-rng.randrange(1, 4))
        vocab = list(vocab.items())
        tok = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", 0.0), *vocab], unk_id=0, byte_fallback=False))
        tok.pre_tokenizer = tokenizers.pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
        counter = token_count.PieceCounter(vocab, remembered=5)
        for _ in range(20):
            s = "".join(rng.choice("abc ▁é") for _ in range(rng.randrange(0, 10)))
            assert counter.many([s]) == [len(tok.encode(s, add_special_tokens=False).ids)], (vocab, s)


def test_line_and_word_counts():
    rng = random.Random(6)
    texts = ["", "\n", " \n\t", "é ü\nß|x"]
    for _ in range(60):
        texts.append("".join(rng.choice(["a ", "b ", "cc ", "\n", "#", "é", "|", "\t", "\x85", "　"]) for _ in range(rng.randrange(0, 60))))
    got = quality_crf.judge_texts(texts, None)
    for k, t in enumerate(texts):
        w = WORD.findall(t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        inside = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        want = (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(inside))
        assert tuple(int(got[c][k]) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, repr(t)
    assert linefeat.repeated_words("a b c a b c")[0] == 6


def test_viterbi_equals_enumeration():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(0)
    field = quality_crf.LineField(np.zeros((1, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    counts = np.array([3, 0, 5, 1])
    score = rng.normal(size=(counts.sum(), 2))
    got, at = quality_crf.viterbi(score, counts, field), 0
    for n in counts:
        if n:
            value = lambda y, at=at: field.first[y[0]] + sum(score[at + i][y[i]] for i in range(len(y))) + sum(field.step[y[i], y[i + 1]] for i in range(len(y) - 1))
            best = max(([(b >> i) & 1 for i in range(n)] for b in range(1 << n)), key=value)
            assert got[at : at + n].tolist() == best
        at += n


def labelled(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        lines = [prose(rng, 15).capitalize() + "." for _ in range(6)]
        rows.append((i, "\n".join(lines if good else [" | ".join(s.split()).upper() for s in lines])))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_operators_learn(spark):
    rows, labels = labelled(random.Random(9), 300)
    docs = docs_frame(spark, [*rows, (1000, None), (1001, ""), (None, "x y z")])
    marks = spark.createDataFrame([*labels, (None, 1, 0), (2000, None, 0)], "doc_id long, quality int, toxic int")
    truth = {i: q for i, q, _ in labels}
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1
    got = quality_rank.score_quality(quality_rank.feature_rows(docs).checkpoint(), marks, learn).collect()
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    none = quality_rank.score_quality(quality_rank.feature_rows(docs), marks.limit(0), learn).collect()
    assert {r.score for r in none} == {0.5}
    field = quality_crf.learn_field(docs, marks)
    kept = {r.doc_id: r.kept for r in quality_crf.judge_quality(docs, field).collect()}
    assert sum(kept[i] == bool(q) for i, q in truth.items()) >= 0.97 * len(truth) and not kept[1000]


def test_language_id_learns(spark):
    rng = random.Random(10)
    letters = {"xx": "abcdefgh", "yy": "nopqrstu", "zz": "éüñçabqz"}
    make = lambda lang, n: " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(n))
    rows = [(i, make(lang, rng.randrange(3, 60)), lang) for i in range(150) for lang in [rng.choice("xyz") * 2]]
    docs = spark.createDataFrame([*rows, (900, None, "xx"), (901, "123 !!", "yy"), (902, make("zz", 9), None)], "doc_id long, text string, lang string").selectExpr("*", "1 AS lang_pred", "2 AS score")
    texts, labels = lang_id.sample_labelled(docs, F.lit(True))
    model = lang_id.train(texts, labels, steps=80)
    got = {r.doc_id: r for r in lang_id.identify(docs, model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in rows) >= 0.97 * len(rows)
    assert got[902].lang_pred == "zz" and all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901))
    assert lang_id.identify(docs.limit(0), model).count() == 0


def test_recurrent_gradients():
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(3)
    x = rng.integers(97, 100, (5, 4))
    embed, recur, ask = rng.normal(size=(6, 256)), rng.normal(size=(6, 3)), rng.normal(size=(5, 3, 4))
    loss = lambda e, u: sum((ask[t] * lang_id._forward(x, e, u, 3)[t + 1][0]).sum() for t in range(5))
    d_embed, d_recur = lang_id._backward(x, lang_id._forward(x, embed, recur, 3), list(ask), recur, 3)
    for got, at, which in ((d_recur, (1, 2), 1), (d_recur, (4, 0), 1), (d_embed, (0, 98), 0), (d_embed, (5, 97), 0)):
        args = [embed.copy(), recur.copy()]
        args[which][at] += 1e-4
        up = loss(*args)
        args[which][at] -= 2e-4
        assert abs((up - loss(*args)) / 2e-4 - got[at]) < 2e-2


def test_licences(spark):
    rng = random.Random(12)
    model = licence_scan.train([prose(rng, 12) for _ in range(200)] + ["mit und der", "den mit"])
    text = "\n".join([prose(rng, 10), "Released under the MIT License.", "Mit und den.", "Licensed under the Apache License, Version 2.0.", "All rights reserved.", "the and of this software"])
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (1, text)], "doc_id long, text string").selectExpr("*", "1 AS line")
    got = sorted((r.doc_id, r.line, r.family) for r in licence_scan.scan_licences(docs, model).collect())
    want = [(1, 1, "MIT"), (1, 3, "Apache-2.0"), (1, 4, "proprietary")]
    assert got == sorted(want * 2)
