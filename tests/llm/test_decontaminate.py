import random

import numpy as np
from keyloom.llm import decontaminate
from keyloom.llm.decontaminate import align, cut_pieces, drop_leaks, find_in_texts, find_leaks, index_items, normalize

WORDS = ["river", "stone", "anchor", "window", "purple", "engine", "garden", "quiet", "letter", "monday", "sugar", "planet"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def prose(rng, n):
    return " ".join("".join(rng.sample("abcdefghijklmnopqrstuvwxyz", 6)) if rng.random() < 0.7 else rng.choice(WORDS) for _ in range(n))


def test_align_equals_least_edits_over_all_parts():
    rng = random.Random(1)
    for _ in range(60):
        item = [rng.choice("ab c") for _ in range(rng.randrange(8, 14))]
        text = [rng.choice("ab c") for _ in range(rng.randrange(8, 25))]
        want = min(edits(item, text[s:e]) for s in range(len(text) + 1) for e in range(s, len(text) + 1))
        code = lambda s: np.array([ord(c) for c in s], np.uint32)
        low = -len(item)
        assert align(code(item), code(text), low, len(text) + len(item) + 1)[0] == want


def test_finds_edited_copies_and_leaves_clean_texts():
    rng = random.Random(2)
    items = [(i, prose(rng, 30)) for i in range(20)]
    index = index_items(items)
    texts, planted = [], set()
    for t in range(60):
        body = prose(rng, rng.randrange(0, 200))
        if t % 3 == 0:
            i, item = rng.choice(items)
            chars = list(item.upper() if t % 2 else item.replace(" ", ",\n"))
            for _ in range(rng.randrange(0, 12)):
                at = rng.randrange(len(chars))
                chars[at] = rng.choice(["", "x", chars[at] + "y"])
            body += ". " + "".join(chars) + " " + prose(rng, 10)
            planted.add((t, i))
        texts.append(body)
    got = find_in_texts(texts, index)
    assert {(t, i) for t, i, *_ in got} == planted
    for t, i, start, end, n in got:
        a, b = normalize(items[i][1])[0].tolist(), normalize(texts[t][start:end])[0].tolist()
        assert edits(a, b) == n <= len(a) // 10


def test_long_texts_are_cut_with_overlap():
    rng = random.Random(3)
    item = prose(rng, 30)
    text = prose(rng, 45_000) + " " + item + " " + prose(rng, 20_000)
    assert {x[1] for x in find_in_texts([text], index_items([(7, item)]))} == {7}


def test_null_empty_and_blocks(spark):
    rng = random.Random(4)
    a, b = prose(rng, 20), prose(rng, 20)
    docs = spark.createDataFrame([(1, a), (1, a), (2, None), (3, ""), (None, b), (5, "short")], "doc_id long, text string").selectExpr("*", "0 AS item_id", "0 AS start")
    bench = spark.createDataFrame([(0, a), (1, b), (2, None), (3, "short"), (4, "")], "item_id int, text string")
    for size in (10, 1000):
        got = sorted((r.doc_id or -1, r.item_id, r.edits) for r in find_leaks(docs, bench, block_chars=size).collect())
        assert got == [(-1, 1, 0), (1, 0, 0), (1, 0, 0)]
    assert find_leaks(docs, bench.limit(0)).count() == 0
    assert find_leaks(docs.limit(0), bench).count() == 0


def least_edits(item, text):
    """Least edits of the item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        old, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (c != d)))
    return min(row)


def plain(text):
    return normalize(text or "")[0].tolist()


def changed(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        chars[at] = rng.choice(["", "q", chars[at] + "z"])
    return "".join(chars)


def planted(rng, lengths, n):
    """Items of these lengths in characters, and texts that hold edited copies up to and beyond the budget."""
    items = [(i, prose(rng, m // 5 + 2)[:m].strip()) for i, m in enumerate(lengths)]
    texts = []
    for t in range(n):
        body = prose(rng, rng.randrange(0, 12))
        if t % 4:
            _, item = rng.choice(items)
            body += " " + changed(rng, item, rng.randrange(0, len(item) // 7 + 2)) + " " + prose(rng, rng.randrange(0, 5))
        texts.append((t, body))
    return items, texts


def test_every_text_against_every_item(spark):
    """Short, middle and long items, those around each change of q too, by plain edit distances."""
    rng = random.Random(7)
    items, texts = planted(rng, [8, 9, 10, 12, 15, 16, 20, 23, 24, 30, 31, 32, 39, 40, 47, 60, 90], 90)
    texts += [(90, None), (91, ""), (None, items[4][1]), (3, texts[3][1])]
    want = sorted({(str(t), i) for t, text in texts for i, item in items if least_edits(plain(item), plain(text)) <= len(plain(item)) // 10 and len(plain(item)) >= 8})
    docs = spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS start", "3 AS edits", "4 AS block")
    bench = spark.createDataFrame([*items, (50, None), (51, "tiny"), (52, "")], "item_id long, text string").selectExpr("*", "1 AS code", "2 AS id")
    for size in (100_000, 12):
        got = find_leaks(docs, bench, block_chars=size).collect()
        assert sorted({(str(r.doc_id), r.item_id) for r in got}) == want
        leaking = {t for t, _ in want}
        kept = sorted(str(r.doc_id) for r in drop_leaks(docs, bench, block_chars=size).collect())
        assert kept == sorted(str(t) for t, _ in texts if str(t) not in leaking)
    assert len(want) > 40 and drop_leaks(docs, bench).columns == docs.columns


def test_long_items_by_passages():
    rng = random.Random(8)
    item = prose(rng, 260)  # some 1800 characters
    code = plain(item)
    assert all((a == b).all() for a, b in zip([cut_pieces(item)[0], cut_pieces(item)[-1]], [np.array(code[:400]), np.array(code[-400:])]))  # noqa: B905
    index = index_items([(5, item)])
    text = "".join(map(chr, code))
    for held, want in ((text, 1), (text[300:1000], 1), (text[650:900], 0), (text[:700] + " " + prose(rng, 200) + " " + text[900:1700], 2)):
        got = find_in_texts([prose(rng, 30) + " " + held + " " + prose(rng, 30)], index)
        assert [x[1] for x in got] == [5] * want
        if want == 1:
            (_, _, start, end, edits), size = got[0], len(held)
            assert edits == 0 and size - 400 <= end - start <= size + 1


def test_many_blocks_open_one_at_a_time(spark, monkeypatch):
    """Fifty blocks: each holds few of the pieces, all texts are read in one scan, and all is found."""
    rng = random.Random(9)
    items = [(i, prose(rng, 12)) for i in range(400)]
    texts = [(t, prose(rng, 20) + " " + changed(rng, items[t][1], 3) + " " + prose(rng, 5)) for t in range(0, 400, 7)]
    bench, docs = (spark.createDataFrame(x, f"{c} long, text string") for x, c in ((items, "item_id"), (texts, "doc_id")))
    size = -(-sum(len(t) for _, t in items) // 50)
    leaks = find_leaks(docs, bench, block_chars=size)
    assert leaks._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.doc_id, r.item_id) for r in leaks.collect()) == [(t, t) for t, _ in texts]
    held = decontaminate.Benchmark(bench, "item_id", "text", 10, size)
    blocks = [sum(len(x.ids) for x in held.indexes(b)) for b in range(held.blocks)]
    assert held.blocks == 50 and held.pieces is None and sum(blocks) == 400 and max(blocks) < 40
    assert [x[1] for x in held.find([t for _, t in texts])] == [t for t, _ in texts]


def test_one_very_long_text_equals_its_parts(monkeypatch):
    rng = random.Random(10)
    items = [(i, prose(rng, 25)) for i in range(6)]
    index = index_items(items)
    text, at = "", []
    for i in (0, 3, 3, 5):
        text += prose(rng, 200) + "! --- " + "#" * 900 + " "
        at.append((i, len(text)))
        text += items[i][1].upper() + " "
    whole = find_in_texts([text.lower()], index)
    assert [(x[1], x[2], x[4]) for x in whole] == sorted((i, s, 0) for i, s in at)
    for stride in (50, 333, 4096):
        monkeypatch.setattr(decontaminate, "STRIDE", stride)
        assert find_in_texts(["short", text, "", items[1][1]], index) == [(1, *x[1:]) for x in whole] + [(3, 1, 0, len(items[1][1]), 0)]
