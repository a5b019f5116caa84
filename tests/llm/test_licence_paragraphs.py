"""Notices over several lines, several in one paragraph, held-out wording, and the table function."""

import random
from dataclasses import replace

import pytest
from keyloom.llm import licence_scan
from keyloom.llm.licence_templates import TEMPLATES

WORDS = ["karlo", "miner", "tusha", "peron", "lokami", "shatu", "nerpe", "ronka", "the", "of", "and", "to", "any", "use"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return licence_scan.train([prose(rng, 12) for _ in range(300)])


def found(text, model):
    return [hit[:3] for hit in licence_scan.scan_text(text, model)]


def test_paragraphs(model):
    rng = random.Random(2)
    wrapped = "\n".join(TEMPLATES["MIT"][0].replace(", ", ",\n").split("\n"))
    n = wrapped.count("\n")
    text = f"{prose(rng, 30)}\n\n{wrapped}\n \t\n{prose(rng, 30)}"
    assert found(text, model) == [(2, 2 + n, "MIT")]
    several = "\n".join([prose(rng, 20), "Released under the MIT License.", prose(rng, 20), "Licensed under CC BY-NC 4.0.", prose(rng, 20)])
    assert found(several, model) == [(1, 1, "MIT"), (3, 3, "CC-BY-NC")]
    assert found("\n\n".join(["", "all rights of any use", "", "the permission of any person"]), model) == []


def test_changed_wording_held_out(model):
    """Notices with words dropped, doubled and put in, which the training never saw, among prose."""
    rng = random.Random(3)
    right = total = wrong = 0
    for family, texts in TEMPLATES.items():
        for text in texts:
            words = text.split()
            if len(words) < 12:
                continue
            for _ in range(3):
                w = [x for x in words if rng.random() > 0.06]
                for _ in range(len(w) // 25 + 1):
                    w.insert(rng.randrange(len(w)), rng.choice(WORDS))
                hits = found(f"{prose(rng, 40)}\n\n{' '.join(w)}\n\n{prose(rng, 40)}", model)
                total += 1
                right += [h[2] for h in hits] == [family]
                wrong += any(h[2] != family for h in hits)
    assert total > 80 and right >= 0.93 * total and wrong <= 0.03 * total
    decoys = [prose(rng, 200) + " license software free copyright " + prose(rng, 5) + " warranty permission" for _ in range(50)]
    assert sum(bool(found(x, model)) for x in decoys) == 0


def test_skipped_parts_hold_nothing(model):
    """With the bound switched off every part gets its exact score; the result is the same."""
    rng = random.Random(4)
    every = replace(model, start=1e9)
    for _ in range(60):
        lines = [prose(rng, rng.randrange(0, 25)) for _ in range(rng.randrange(1, 5))]
        family = rng.choice([*TEMPLATES])
        words = rng.choice(TEMPLATES[family]).split()
        lines.insert(rng.randrange(len(lines) + 1), f"{prose(rng, rng.randrange(0, 9))} {' '.join(words[: rng.randrange(2, len(words) + 1)])}. {prose(rng, rng.randrange(0, 9))}")
        text = "\n".join(lines)
        assert licence_scan.scan_text(text, model) == licence_scan.scan_text(text, every)


def test_table(spark, model):
    rng = random.Random(5)
    notice = "Released under the MIT License."
    texts = [None, "", " \n\n", notice, notice, f"{prose(rng, 60_000)}. {notice} {prose(rng, 60_000)}\n{'x' * 200_000}", f"é\n\n{notice}\r\n\n{prose(rng, 9)}"]
    rows = [(i if i != 4 else 3, t) for i, t in enumerate(texts)] + [(None, notice)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'f' AS family", "1 AS probability", "2 AS last_line")
    got = sorted((str(r.doc_id), r.line, r.last_line, r.family, r.probability, r.likeness) for r in licence_scan.scan_licences(docs, model).collect())
    assert got == sorted((str(i), *hit) for i, t in rows for hit in licence_scan.scan_text(t or "", model))
    assert [g[:4] for g in got] == [("3", 0, 0, "MIT"), ("3", 0, 0, "MIT"), ("5", 0, 0, "MIT"), ("6", 2, 2, "MIT"), ("None", 0, 0, "MIT")]
    assert licence_scan.scan_licences(docs.limit(0), licence_scan.learn_licences(docs.limit(0))).count() == 0
