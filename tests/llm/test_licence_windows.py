import random

from keyloom.llm import licence_scan
from keyloom.llm.licence_templates import TEMPLATES

WORDS = ["karlo", "miner", "tusha", "peron", "lokami", "shatu", "nerpe", "ronka", "the", "of", "and"]


def test_notice_within_a_long_line_is_found():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    model = licence_scan.train([prose(12) for _ in range(200)])
    for family, texts in TEMPLATES.items():
        at = lambda text: [(hit[0], hit[2]) for hit in licence_scan.scan_text(text, model)]
        for text in texts:
            alone = at(text)
            assert alone == [(0, family)]
            within = f"{prose(150)} {text} {prose(150)}"
            if len(licence_scan.words_of(text)) > 3:  # three words prove nothing among others
                assert at(f"{prose(300)}\n{within}") == [(1, family)]
            assert at(f"{prose(150)}. {text.rstrip('.')}. {prose(150)}") == [(0, family)]
    assert licence_scan.scan_text(prose(3000), model) == []
