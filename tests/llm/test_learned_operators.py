"""The learned operators' whole results against plain computations, and their edge cases."""

import math
import random
import re
import zlib

import numpy as np
import pytest
from keyloom.llm import lang_id, linefeat, quality_crf, quality_rank
from keyloom.llm.sampling import count_labels, hash_sample
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CRC = lambda i: zlib.crc32(str(i).encode())


def prose(rng, n, letters="abcdefghijklmno"):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


def junk(rng, n):
    return " | ".join(w.upper() + rng.choice(["***", "###", "!"]) for w in prose(rng, n).split())


def corpus(rng, n):
    """Rows (doc_id, text, quality): good pages, bad ones, and pages of both kinds of line."""
    rows = []
    for i in range(n):
        good = rng.random() < 0.6
        lines = [(prose if good else junk)(rng, rng.randrange(4, 20)) + ("." if good else "") for _ in range(rng.randrange(3, 9))]
        rows.append((i, "\n".join(lines), int(good)))
    return rows


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(31)
    rows = corpus(rng, 160)
    extra = [(900, None), (901, ""), (902, "\n \n"), (903, "7 8 9"), (904, "x" * 300_000 + " é\n" + "ab " * 40_000), (None, prose(rng, 60)), (3, rows[3][1]), (905, rows[5][1])]
    langs = {i: rng.choice(["xx", "yy"]) for i, _, _ in rows}
    texts = [(i, t if langs[i] == "xx" else t.translate(str.maketrans("abcdefghijklmnoABCDEFGHIJKLMNO", "éüñpqrstuvwxyzßÉÜÑPQRSTUVWXYZß")), langs[i]) for i, t, _ in rows]
    texts += [(i, t, None) for i, t in extra]
    d = str(tmp_path_factory.mktemp("learned"))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "'p' AS lang_pred", "2 AS _letter", "3 AS feats", "true AS kept", "4 AS h", "5 AS label")
    docs.write.parquet(f"{d}/documents.parquet")
    marks = [(i, q, 0) for i, _, q in rows] + [(None, 1, 0), (5000, None, 0), (5001, 1, 0), (7, 1 - rows[7][2], 0)]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, texts, {i: q for i, q, _ in marks if i is not None and i != 7 and i < 5000}


def in_hash_order(spark, ids):
    return [r.i for r in spark.createDataFrame([(i,) for i in ids], "i long").orderBy(F.xxhash64(F.lit("pick"), "i")).collect()]


def shares(model, text):
    """Language shares by plain passes, byte by byte."""
    raw = text.lower().encode("utf-8", "replace")
    total, hid = np.zeros(len(model.langs)), model.recur.shape[2]
    for lo in range(0, len(raw), lang_id.SEGMENT):
        x = np.frombuffer(raw[lo : lo + lang_id.SEGMENT], np.uint8)[:, None].astype(int)
        ahead, back = (lang_id._forward(y, model.embed[k], model.recur[k], hid) for k, y in enumerate((x, x[::-1])))
        for t in range(len(x)):
            z = model.out[0] @ ahead[t + 1][0] + model.out[1] @ back[len(x) - t][0] + model.bias[:, None]
            e = np.exp(z[:, 0] - z.max())
            total += e / e.sum()
    return total / max(1, len(raw))


def test_language_id_equals_plain_passes(spark, tables):
    d, texts, _ = tables
    got = lang_id.op9_language_id(spark, d).collect()
    model = lang_id.learn_languages(spark.read.parquet(f"{d}/documents.parquet"))
    assert model.langs == ["xx", "yy"]
    want = []
    for i, t, _ in texts:
        held = i is not None and CRC(i) % 4 == 2
        if not t or not any(c.isalpha() for c in t):
            want.append((i, held, "und", 0.0))
        elif len(t) < 100_000:
            p = shares(model, t)
            want.append((i, held, model.langs[int(p.argmax())], float(p.max())))
    key = lambda r: (str(r[0]), r[2], r[3])
    short = sorted((tuple(r) for r in got if r.doc_id != 904), key=key)
    assert len(got) == len(texts) and len(short) == len(want)
    for a, b in zip(short, sorted(want, key=key), strict=True):
        assert a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-3
    long_one = next(r for r in got if r.doc_id == 904)
    assert long_one.lang_pred in model.langs and 0 <= long_one.score <= 1


def test_language_sample_is_of_the_learnable_rows(spark, tables):
    d, texts, _ = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    known = {i: (t, lang) for i, t, lang in texts if lang and CRC(i) % 4 != 2}
    order = {lang: [i for i in in_hash_order(spark, known) if known[i][1] == lang] for lang in ("xx", "yy")}
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    for parts in (1, 7):
        got = lang_id.sample_labelled(docs.repartition(parts), learn, per_lang=5, chars=10_000)
        assert got == ([known[i][0] for lang in ("xx", "yy") for i in order[lang][:5]], ["xx"] * 5 + ["yy"] * 5)
    assert lang_id.identify(docs.limit(0), lang_id.learn_languages(docs.limit(0))).count() == 0
    assert {r.lang_pred for r in lang_id.identify(docs, lang_id.learn_languages(docs.limit(0))).select("lang_pred").collect()} == {"und"}


def test_identify_leaves_other_columns(spark, tables):
    d = tables[0]
    docs = spark.read.parquet(f"{d}/documents.parquet")
    out = lang_id.identify(docs, lang_id.LangModel([], *(np.zeros(0),) * 4))
    assert out.columns == [c for c in docs.columns if c not in ("score", "lang_pred")] + ["lang_pred", "score"]
    assert out.select("_letter", "h").distinct().collect() == [(2, 4)]


def test_sample_loosens_its_bound(spark):
    """One id with most of the rows, and rows that ``attach`` drops."""
    rows = spark.range(3000).select(F.lit("a").alias("label"), F.when(F.col("id") < 2700, 7).otherwise(F.col("id")).alias("i"))
    rows = rows.select("label", F.xxhash64(F.lit("pick"), "i").alias("h"), "i")
    got = hash_sample(rows, 50, count_labels(rows), lambda near: near.where("i % 2 = 0"))
    ids = [i for i in in_hash_order(spark, range(2700, 3000)) if i % 2 == 0]
    assert [r["i"] for r in got["a"]] == ids[:50]
    assert hash_sample(rows.limit(0), 5, count_labels(rows.limit(0))) == {}
    with pytest.raises(ValueError, match="labels"):
        count_labels(spark.range(2000).select(F.col("id").alias("label")))


def test_quality_scores_equal_a_plain_computation(spark, tables):
    d, texts, truth = tables
    got = quality_rank.op10_quality_rank(spark, d).collect()
    x = {(i, t): quality_rank.text_features([t or ""])[0].astype(float) for i, t, _ in texts}
    of_id = {i: min((v for (j, _), v in x.items() if j == i), key=list) for i, _ in x if i is not None}
    learn = in_hash_order(spark, [i for i in truth if CRC(i) % 3 != 1])
    good, bad = (np.array([of_id[i] for i in learn if truth[i] == y]) for y in (1, 0))
    w = quality_rank.fit_pairs(good, bad)
    raw = sorted(float(x[i, t] @ w) for i, t, _ in texts)
    levels = sorted({raw[max(0, math.ceil(k * len(raw) / 1000) - 1)] for k in range(1, 1000)})
    marked = [(float(v @ w), truth[i]) for (i, t), v in x.items() if i in truth and CRC(i) % 3 != 1]
    marked += [(float(x[3, t] @ w), truth[3]) for i, t, _ in texts[160:] if i == 3 and CRC(3) % 3 != 1]
    errors = [sum((r < c) == (y == 1) for r, y in marked) for c in levels]
    best = [k for k, e in enumerate(errors) if e == min(errors)]
    k = best[len(best) // 2]
    cut_at = (levels[k] + levels[max(0, k - 1)]) / 2
    want = sorted((str(i), i is not None and CRC(i) % 3 == 1, round(1 / (1 + math.exp(-min(30, max(-30, float(x[i, t] @ w) - cut_at)))), 6)) for i, t, _ in texts)
    assert sorted((str(r.doc_id), r.held_out, round(r.score, 6)) for r in got) == want
    assert all(r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert len(held) > 20 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_quality_tables_without_rows(spark, tables):
    d = tables[0]
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    empty = quality_rank.feature_rows(docs.limit(0))
    assert quality_rank.score_quality(empty, marks, F.lit(True)).count() == 0
    assert quality_crf.learn_field(docs.limit(0), marks) is None and quality_crf.learn_field(docs, marks.where("quality = 1")) is None
    assert quality_crf.judge_quality(docs.limit(0), None).count() == 0


def best_labels(score, field):
    """By trying every sequence."""
    n = len(score)
    value = lambda y: field.first[y[0]] + sum(score[k][y[k]] for k in range(n)) + sum(field.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B905, E731
    return max(([(code >> k) & 1 for k in range(n)] for code in range(1 << n)), key=value)


def test_line_labels_and_verdicts_equal_enumeration(spark, tables):
    d, texts, truth = tables
    docs, marks = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    field = quality_crf.learn_field(docs, marks)
    got = sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept, round(r.content_share, 9)) for r in quality_crf.op8_quality_crf(spark, d).collect() if r.doc_id != 904)
    want = []
    for i, t, _ in texts:
        if i == 904:
            continue
        lines, words = (t or "").split("\n"), WORD.findall(t or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(3)}
        x = quality_crf.line_features(linefeat.read_lines([t or ""]))
        y = best_labels(x @ field.emit, field)
        size = [len(s) for s in lines]
        share = sum(n for n, label in zip(size, y, strict=True) if label == quality_crf.CONTENT) / max(1, sum(size))
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        want.append((str(i), len(words), failed, not failed and share >= quality_crf.MIN_CONTENT, round(share, 9)))
    assert got == sorted(want)
    judged = {r.doc_id: r.kept for r in quality_crf.judge_quality(docs, field).collect() if not r.base_failed}
    assert sum(judged[i] == bool(truth[i]) for i in judged if i in truth) >= 0.95 * sum(i in truth for i in judged)


def test_mixed_pages_get_mixed_labels():
    rng = random.Random(5)
    rows = corpus(rng, 200)
    field = quality_crf.fit_texts([t for _, t, _ in rows], [q for _, _, q in rows])
    assert not np.allclose(field.step, field.step[0, 0])
    right = total = 0
    for _ in range(40):
        kinds = [0] * rng.randrange(2, 6) + [1] * rng.randrange(2, 6) + [0] * rng.randrange(2, 6)
        lines = [(junk if k else prose)(rng, 12) for k in kinds]
        x = linefeat.read_lines(["\n".join(lines)])
        found = quality_crf.viterbi(quality_crf.line_features(x) @ field.emit, np.array([len(lines)]), field)
        right += int((found == np.array(kinds)).sum())
        total += len(kinds)
    assert right >= 0.95 * total


def test_good_lines_of_bad_texts_are_relabelled():
    rng = random.Random(8)
    texts = [prose(rng, 12) + "\n" + prose(rng, 12) for _ in range(60)] + ["\n".join([junk(rng, 12), prose(rng, 12), junk(rng, 12)]) for _ in range(60)]
    field = quality_crf.fit_texts(texts, [1] * 60 + [0] * 60)
    x = linefeat.read_lines(["\n".join([junk(rng, 12), prose(rng, 12), prose(rng, 14), junk(rng, 12)])])
    assert quality_crf.viterbi(quality_crf.line_features(x) @ field.emit, np.array([4]), field).tolist() == [1, 0, 0, 1]


def test_field_gradients_by_differences():
    rng = np.random.default_rng(2)
    counts = np.array([3, 1, 5, 2])
    feats, labels = rng.normal(size=(counts.sum(), 4)), rng.integers(0, 2, counts.sum())
    p = [rng.normal(size=s) for s in ((4, 2), (2, 2), (2,))]
    value = lambda: -quality_crf.field_gradients(feats, counts, labels, quality_crf.LineField(*p))[0]
    loglik, grads = quality_crf.field_gradients(feats, counts, labels, quality_crf.LineField(*p))
    total, at = 0.0, 0
    for n in counts:  # log-likelihood by enumeration
        score = feats[at : at + n] @ p[0]
        worth = lambda y, score=score, n=n: p[2][y[0]] + sum(score[k][y[k]] for k in range(n)) + sum(p[1][a, b] for a, b in zip(y, y[1:]))  # noqa: B905, E731
        every = [worth([(code >> k) & 1 for k in range(n)]) for code in range(1 << n)]
        total += worth(labels[at : at + n].tolist()) - np.logaddexp.reduce(every)
        at += n
    assert abs(loglik - total / counts.sum()) < 1e-9
    for i, g in enumerate(grads):
        for at in np.ndindex(g.shape):
            p[i][at] += 1e-5
            up = value()
            p[i][at] -= 2e-5
            assert abs((up - value()) / 2e-5 - g[at]) < 1e-5
            p[i][at] += 1e-5


def test_lines_longer_than_a_stride(monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choice(["a ", "b", "cc ", "\n", "#", "é", "|", "\t", "!", "x y\n"]) for _ in range(rng.randrange(0, 400))) for _ in range(40)] + ["", "\n", "z" * 200]
    whole, again = linefeat.read_lines(texts), [linefeat.repeated_words(t) for t in texts]
    for stride in (3, 17, 64):
        monkeypatch.setattr(linefeat, "STRIDE", stride)
        parts = linefeat.read_lines(texts)
        for name in ("counts", "doc", "words", "repeated", "last"):
            assert (getattr(parts, name) == getattr(whole, name)).all(), (stride, name)
        assert [linefeat.repeated_words(t) for t in texts] == again
