"""Licence scans: a trained classifier of paragraphs, confirmed by template comparison.

A paragraph is a run of lines between blank ones. Its lower-cased words and word pairs are the
features of a multinomial logistic regression over the licence families and an unknown class. It is
trained in numpy on spans and runs of the templates, mixed with corpus words, and on a bounded
sample of corpus lines (``SAMPLE`` texts by hash order of their ids, ``SAMPLE_CHARS`` characters of each, the
first ``SAMPLE_LINES`` of their lines that no template resembles); a temperature is fitted on a part
held back, so that probabilities are calibrated and "unknown" is chosen where it is likelier.

A family counts only when templates confirm it: the paragraph as a whole when at least ``MIN_ALIKE``
of its word pairs are in the family's templates, so a notice broken over lines is one paragraph. A
paragraph that is not confirmed as a whole is looked at by its lines, its sentences and half
overlapping windows of ``WINDOW`` words, twice as many and so on to twice the longest template, so
that a notice among other text keeps its evidence; there also a template that the part holds to
that share confirms. Of parts that overlap that with most of the family's wording stays, neighbouring
ones of a family are one hit, and a paragraph may hold several. Parts whose features cannot outweigh the unknown class, by an
upper bound of their sum, skip the exact scores.

Every text is read whole, in Arrow batches; null and empty texts hold nothing. Repeated rows give
repeated results. Columns other than the id and the text are not read. An empty table gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.licence_templates import TEMPLATES
from keyloom.llm.sampling import hash_sample
from keyloom.sources import read_table

SAMPLE = 400
SAMPLE_CHARS = 2000
SAMPLE_LINES = 6000
WINDOW = 8
MIN_ALIKE = 0.6
UNKNOWN = "unknown"
_WORD = re.compile(r"[a-z0-9]+")
_SENTENCE = re.compile(r"[.!?;](?:\s|$)")


def words_of(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


@dataclass
class LicenceModel:
    families: list[str]  # the last is UNKNOWN
    terms: dict  # word or pair of words: row of weights
    weights: np.ndarray  # (terms, families)
    bias: np.ndarray
    margin: dict  # term: the most that it can add to a family over UNKNOWN
    start: float  # the largest bias over UNKNOWN's
    templates: dict[str, list[frozenset]]
    wording: dict[str, frozenset]  # the pairs of all templates of a family
    longest: int


def _pairs(words: list[str]) -> frozenset:
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset((w,) for w in words)  # noqa: B905


def alike(words: list[str], templates: list[frozenset]) -> float:
    """The largest share, over templates, of pairs held by the other side."""
    own = _pairs(words)
    if not own:
        return 0.0
    return max(max(len(own & t) / len(own), len(own & t) / len(t) if len(t) > 2 else 0.0) for t in templates)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _samples(lines: list[list[str]], split: dict[str, list[list[str]]], spans: int, rng: np.random.Generator) -> list[tuple[list[str], int]]:
    """(words, class): corpus lines, spans and runs of templates among corpus words, and licence words out of place."""
    families, pool = [*split], [x for w in lines for x in w] or ["lorem"]
    some = lambda n: [str(pool[i]) for i in rng.integers(0, len(pool), n)]
    out = [(w, len(families)) for w in lines]
    for k, ws in enumerate(split.values()):
        for n in range(spans):
            w = ws[n % len(ws)]
            if n >= 2 * len(ws) and n % 4 == 0:  # a notice of several sentences
                lo = int(rng.integers(0, len(ws)))
                w = [x for part in ws[lo : lo + 3] for x in part]
            size = len(w) if n < 3 * len(ws) else int(rng.integers(max(2, 2 * len(w) // 3), len(w) + 1))
            lo = int(rng.integers(0, len(w) - size + 1))
            extra = some(int(rng.integers(0, 6))) if n >= len(ws) else []
            out.append((extra[:2] + w[lo : lo + size] + extra[2:], k))
    for _ in range(len(families) * spans // 2):
        ws = split[families[int(rng.integers(len(families)))]]
        w = ws[int(rng.integers(len(ws)))]
        out.append(([w[i] for i in rng.integers(0, len(w), 1 + int(rng.integers(0, 2)))] + some(int(rng.integers(1, 12))), len(families)))
    return out


def train(corpus_lines: list[str], *, spans: int = 100, steps: int = 200, penalty: float = 1e-4, seed: int = 5, most_lines: int = SAMPLE_LINES) -> LicenceModel:
    """``most_lines`` bounds the corpus lines learned from."""
    rng = np.random.default_rng(seed)
    families = [*TEMPLATES, UNKNOWN]
    split = {f: [words_of(t) for t in ts] for f, ts in TEMPLATES.items()}
    templates = {f: [_pairs(w) for w in ws] for f, ws in split.items()}
    every = [t for ts in templates.values() for t in ts]
    lines = [w for w in map(words_of, corpus_lines) if w and alike(w, every) < 0.3][:most_lines]
    terms: dict = {}
    for ws in split.values():
        for w in ws:
            for t in (*w, *zip(w, w[1:])):  # noqa: B905
                terms.setdefault(t, len(terms))
    samples = _samples(lines, split, spans, rng)
    n, k, bias = len(samples), len(families), len(terms)
    # Sparse rows: (sample, term, value), the bias being a term of every sample.
    rows = [(i, terms[t], 1 / len(w) ** 0.5) for i, (w, _) in enumerate(samples) for t in (*w, *zip(w, w[1:])) if t in terms]  # noqa: B905
    rows += [(i, bias, 1.0) for i in range(n)]
    at, term = (np.array([r[j] for r in rows], np.int64) for j in (0, 1))
    value = np.array([r[2] for r in rows], np.float64)
    held = rng.random(n) < 0.2
    y, gold = np.array([c for _, c in samples]), np.eye(k)[[c for _, c in samples]]
    used = ~held[at]
    order = np.argsort(at, kind="stable")
    logits = lambda w: np.add.reduceat(w[term[order]] * value[order, None], np.searchsorted(at[order], np.arange(n)))
    by_term = np.flatnonzero(used)[np.argsort(term[used], kind="stable")]
    seen, first = np.unique(term[by_term], return_index=True)
    w, m, v = (np.zeros((bias + 1, k)) for _ in range(3))
    for t in range(1, steps + 1):
        e = (_softmax(logits(w)) - gold) / (~held).sum()
        g = np.zeros_like(w)
        g[seen] = np.add.reduceat(e[at[by_term]] * value[by_term, None], first)
        g[:-1] += penalty * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    z = logits(w)[held]  # the temperature with the least loss on what was held back
    sharp = min((float(-np.log(_softmax(s * z)[np.arange(len(z)), y[held]] + 1e-12).mean()), s) for s in np.linspace(0.2, 3, 29))[1] if held.any() else 1.0
    w *= sharp
    gain = (w[:, :-1] - w[:, -1:]).max(1)
    return LicenceModel(families, terms, w[:-1], w[-1], {t: float(gain[i]) for t, i in terms.items()}, float(gain[-1]), templates, {f: frozenset().union(*ts) for f, ts in templates.items()}, max(len(x) for ws in split.values() for x in ws))


def classify(words: list[str], model: LicenceModel) -> tuple[str, float]:
    """The likeliest class of a paragraph and its probability."""
    rows = [i for t in (*words, *zip(words, words[1:])) if (i := model.terms.get(t)) is not None]  # noqa: B905
    z = model.bias + model.weights[rows].sum(0) / np.sqrt(max(1, len(words)))
    p = _softmax(z[None])[0]
    return model.families[int(p.argmax())], float(p.max())


def _sums(values: list[float]) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(values)])


def spans_of(lines: list[tuple[int, str, list[str]]], gains: list[float], pairs: list[float], model: LicenceModel) -> list[tuple[int, int]]:
    """Lines, sentences and windows (from, to, in words) whose features can outweigh the unknown class
    and that hold a pair of a template, as none without is confirmed."""
    n = len(gains)
    ends = np.cumsum([0, *(len(w) for _, _, w in lines)])
    spans = {(int(a), int(b)) for a, b in zip(ends, ends[1:])}  # noqa: B905
    at = 0
    for sentence in _SENTENCE.split("\n".join(text for _, text, _ in lines)):
        size = len(words_of(sentence))
        spans.add((at, at + size))
        at += size
    size = WINDOW
    while size < n:
        spans |= {(i, i + size) for i in (*range(0, n - size, size // 2), n - size)}
        if size >= 2 * model.longest:
            break
        size *= 2
    both = np.array([s for s in sorted(spans) if s[1] - s[0] > 1 and s != (0, n)], np.int64).reshape(-1, 2)
    lo, hi = both.T
    w, p, held = _sums(gains), _sums(pairs), _sums([x != 0 for x in pairs])
    most = w[hi] - w[lo] + p[hi - 1] - p[lo]
    fits = (most / np.sqrt(np.maximum(1, hi - lo)) + model.start > 0) & (held[hi - 1] > held[lo])
    return [(int(a), int(b)) for a, b in both[fits]]


def scan_paragraph(lines: list[tuple[int, str, list[str]]], model: LicenceModel) -> list[tuple[int, int, str, float, float]]:
    """(first line, last line, family, probability, likeness) of what is confirmed; lines: (number, text, words)."""
    words = [w for _, _, own in lines for w in own]
    line_of = [k for k, _, own in lines for _ in own]
    gain = model.margin.get
    gains = [gain(w, 0.0) for w in words]
    pairs = [gain(p, 0.0) for p in zip(words, words[1:])]  # noqa: B905
    if len(words) <= 8 * model.longest and (sum(gains) + sum(pairs)) / len(words) ** 0.5 + model.start > 0:
        family, p = classify(words, model)
        own = _pairs(words)
        if family != UNKNOWN and (same := len(own & model.wording[family]) / len(own)) >= MIN_ALIKE:
            return [(line_of[0], line_of[-1], family, p, same)]
    if not any(pairs):  # no part is like a template
        return []
    parts = []
    for lo, hi in spans_of(lines, gains, pairs, model):
        family, p = classify(words[lo:hi], model)
        if family != UNKNOWN and (same := alike(words[lo:hi], model.templates[family])) >= MIN_ALIKE:
            own = _pairs(words[lo:hi])
            parts.append((-p * (2 * len(own & model.wording[family]) - len(own)), lo, hi, family, p, same))  # pairs of the family's less others
    taken: list[list] = []
    for _, lo, hi, family, p, same in sorted(parts):
        if all(hi <= t[0] or t[1] <= lo for t in taken):
            taken.append([lo, hi, family, p, same])
    out: list[list] = []
    for t in sorted(taken):
        if out and out[-1][2] == t[2] and t[0] - out[-1][1] < WINDOW and line_of[t[0]] - line_of[out[-1][1] - 1] <= 1:
            out[-1][1:] = [t[1], t[2], max(out[-1][3], t[3]), max(out[-1][4], t[4])]
        else:
            out.append(t)
    return [(line_of[lo], line_of[hi - 1], family, p, same) for lo, hi, family, p, same in out]


def scan_text(text: str, model: LicenceModel) -> list[tuple[int, int, str, float, float]]:
    """(first line, last line, family, probability, likeness) of the confirmed parts, lines from 0."""
    out, lines = [], []
    for n, line in enumerate(text.split("\n")):
        if words := words_of(line):
            lines.append((n, line, words))
        elif lines and not line.strip():
            out += scan_paragraph(lines, model)
            lines = []
    return out + scan_paragraph(lines, model) if lines else out


def learn_licences(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> LicenceModel:
    place = 1 + F.pmod(F.xxhash64(F.lit("place"), id_col), F.greatest(F.lit(1), F.length(text_col) - chars + 1)).cast("int")
    rows = docs.select(F.lit("any").alias("label"), F.xxhash64(F.lit("pick"), id_col).alias("h"), F.col(text_col).substr(place, F.lit(chars)).alias("text"))
    got = hash_sample(rows, sample, {"any": docs.count()}, lambda near: near.where(F.length("text") > 0))
    return train([line for r in got.get("any", []) for line in r["text"].split("\n")])


def scan_licences(docs: DataFrame, model: LicenceModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line, last_line, family, probability, likeness): every confirmed notice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, hits = [], []
            for i, text in enumerate(batch.column(1)):
                for hit in scan_text(text.as_py() or "", model):
                    at.append(i)
                    hits.append(hit)
            cols = [pa.array([h[k] for h in hits], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *cols], names=[id_col, "line", "last_line", "family", "probability", "likeness"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, line long, last_line long, family string, probability double, likeness double")


def op3_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return scan_licences(docs, learn_licences(docs))


QUERIES = {"op3_licence_scan": op3_licence_scan}
