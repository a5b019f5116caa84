"""Hot buckets: texts around a common passage, and a group of copies on both sides of the threshold."""

import random

from keyloom.llm import near_dedup

SYLLABLES = ["ka", "lo", "mi", "ner", "tu", "sha", "pe", "ron", "vi", "das"]


def words(rng, n):
    return ["".join(rng.choice(SYLLABLES) for _ in range(3)) for _ in range(n)]


def rows_of(rng):
    passage, base = words(rng, 80), words(rng, 120)
    rows = [(i, " ".join(words(rng, rng.randrange(5, 30)) + passage)) for i in range(60)]
    for i in range(60, 140):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = words(rng, 1)[0]
        rows.append((i, " ".join(w)))
    return rows


def test_hot_buckets_brute_force(spark):
    rows = rows_of(random.Random(3))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    comp = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), size=5).collect()
    assert {r.doc_id: r.component_id for r in got} == comp
    assert 1 < len(set(comp.values())) < len(comp)


def test_rare_entries_keep_every_link(spark):
    """Every linked pair shares a bucket in which both have room for the overlap."""
    rows = rows_of(random.Random(4))
    sh = near_dedup.Shingler(5)
    sets = {i: set(sh.hashes(t).tolist()) for i, t in rows}
    full = near_dedup._full(spark.createDataFrame(rows, "doc_id long, text string"), 5, 33)
    entries = spark.createDataFrame([(0, i, 1) for i in sets], "key long, id long, w long")
    got = near_dedup._rare_entries(entries, full, 80).collect()
    held = {}
    for r in got:
        held.setdefault(r.key, []).append((r.id, r.n, r.pos))
    met = set()
    for group in held.values():
        met |= {(a, b) for a, n, p in group for b, m, q in group if a < b and min(n - p, m - q) * 180 >= 80 * (n + m)}
    links = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert links and links <= met
