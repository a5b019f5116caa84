"""Quality rules: a linear-chain conditional random field labels lines content or boilerplate.

Each line becomes a few yes/no features of its characters; Viterbi decoding labels all lines of a
text together, and the share of characters in content lines decides whether it is kept. The field
is trained in numpy, by forward-backward and gradient steps, on a bounded sample of labelled rows
(``SAMPLE`` of each label by hash order, a window of ``SAMPLE_CHARS`` characters of each): the lines
of a text labelled 1 are content, those of a text labelled 0 boilerplate, but for lines that look
like content by themselves; besides the texts as they are it sees as many into which runs of lines
of the other kind are put, so it learns where labels change within a page. Counts, decoding and
verdicts are over whole texts, in Arrow batches.

A null text has no words. Texts with fewer than ``MIN_WORDS`` words, or with more than half of
their words in repeated 3-word windows, fail the base rules. Without labels of both kinds a text is
kept when it passes those. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.linefeat import Lines, per_text, read_lines, repeated_words
from keyloom.llm.sampling import agreed_labels, count_labels, hash_sample
from keyloom.llm.text import text_groups
from keyloom.sources import read_table

SAMPLE = 700
SAMPLE_CHARS = 2500
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
MIN_CONTENT = 0.5
CONTENT, BOILERPLATE = 0, 1


@dataclass
class LineField:
    emit: np.ndarray  # (features, 2)
    step: np.ndarray  # (2, 2): from a line's label to the next one's
    first: np.ndarray  # (2,)


def line_features(x: Lines) -> np.ndarray:
    words, chars = x.words, np.maximum(x.of("start") - x.of("blank"), 1)
    symbol, upper, bang, digit, pipe = (x.share(k) for k in ("symbol", "upper", "bang", "digit", "pipe"))
    width = chars / np.maximum(words, 1)
    ends = np.isin(x.last, np.frombuffer(b".?:;", np.uint8))
    cols = [
        np.ones(len(words), bool),
        symbol > 0.005,
        symbol > 0.03,
        symbol > 0.1,
        pipe > 0.01,
        upper > 0.2,
        upper > 0.5,
        bang > 0.01,
        bang > 0.05,
        digit > 0.1,
        digit > 0.3,
        words == 0,
        (words > 0) & (words < 3),
        words >= 10,
        words >= 40,
        ends,
        x.repeated,
        width < 3,
        width > 10,
    ]
    return np.stack(cols, 1).astype(np.float32)


def _order(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts by falling line count, and how many have a line at each place."""
    order = np.argsort(-counts, kind="stable")
    alive = np.searchsorted(-counts[order], -np.arange(counts.max(initial=0)), "left")
    return order, alive


def viterbi(score: np.ndarray, counts: np.ndarray, field: LineField) -> np.ndarray:
    """The best labels of every text's lines; score: (lines, 2), texts one after the other."""
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order, alive = _order(counts)
    starts = starts[order]
    back = np.zeros((len(score), 2), np.int8)
    best = np.zeros((len(counts), 2))
    for t, n in enumerate(alive):
        at = starts[:n] + t
        if t == 0:
            best[:n] = field.first + score[at]
            continue
        via = best[:n, :, None] + field.step
        back[at] = via.argmax(1)
        best[:n] = via.max(1) + score[at]
    labels = np.zeros(len(score), np.int8)
    now = best.argmax(1).astype(np.int8)
    for t in range(len(alive) - 1, -1, -1):
        at = starts[: alive[t]] + t
        labels[at] = now[: alive[t]]
        now[: alive[t]] = back[at, now[: alive[t]]]
    return labels


def field_gradients(feats: np.ndarray, counts: np.ndarray, labels: np.ndarray, field: LineField, penalty: float = 0.0) -> tuple[float, list[np.ndarray]]:
    """Mean log-likelihood of the labels for a line, and the gradients of its negative (plus the
    penalty), by forward-backward over all texts at once: a step of time takes those texts that are
    long enough. Texts one after the other; ``counts`` lines in each, one at least."""
    emit, step, first = field.emit, field.step, field.first
    n = len(feats)
    starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    order, alive = _order(counts)
    begins = starts[order]
    e = feats @ emit
    fwd, bwd = np.empty((n, 2)), np.zeros((n, 2))
    fwd[starts] = first + e[starts]
    for t in range(1, len(alive)):
        at = begins[: alive[t]] + t
        past = fwd[at - 1]
        fwd[at] = np.logaddexp(past[:, :1] + step[0], past[:, 1:] + step[1]) + e[at]
    for t in range(len(alive) - 1, 0, -1):
        at = begins[: alive[t]] + t
        nxt = bwd[at] + e[at]
        bwd[at - 1] = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
    z = np.logaddexp(fwd[starts, 0] + bwd[starts, 0], fwd[starts, 1] + bwd[starts, 1])
    doc = np.repeat(np.arange(len(counts)), counts)
    prob = np.exp(fwd + bwd - z[doc, None])
    gold = np.eye(2)[labels]
    left = np.flatnonzero(doc[1:] == doc[:-1])  # lines with a next one
    pair = np.exp(fwd[left, :, None] + step + (e + bwd)[left + 1, None, :] - z[doc[left], None, None]).sum(0)
    gold_step = gold[left].T @ gold[left + 1]
    loglik = float((e * gold).sum() + (step * gold_step).sum() + (gold[starts] * first).sum() - z.sum()) / n
    grads = [feats.T @ (prob - gold) / n, (pair - gold_step) / n, (prob[starts] - gold[starts]).sum(0) / n]
    return loglik, [g + penalty * p for g, p in zip(grads, (emit, step, first), strict=True)]


def fit_field(feats: np.ndarray, counts: np.ndarray, labels: np.ndarray, *, steps: int = 120, rate: float = 0.15, penalty: float = 1e-3, chain: bool = True) -> LineField:
    """Maximum likelihood of the labels by gradient steps; without ``chain`` each line for itself."""
    p = [np.zeros((feats.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)]
    m, v = ([np.zeros_like(a) for a in p] for _ in range(2))
    for k in range(1, steps + 1):
        for i, g in enumerate(field_gradients(feats, counts, labels, LineField(*p), penalty)[1][: 3 if chain else 1]):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.99**k)) + 1e-8)
    return LineField(*p)


def mixed_sequences(texts: list[str], labels: list[np.ndarray], *, seed: int = 13) -> tuple[list[str], list[np.ndarray]]:
    """For each text one with a run of another text's lines put between its own, at any place, so
    that changes of label are seen in training."""
    rng = np.random.default_rng(seed)
    lines = [t.split("\n") for t in texts]
    runs = {y: [i for i, own in enumerate(labels) if (own == y).any()] for y in (CONTENT, BOILERPLATE)}
    out: tuple[list[str], list[np.ndarray]] = ([], [])
    for own, y in zip(lines, labels, strict=True):
        other = BOILERPLATE if (y == CONTENT).mean() >= 0.5 else CONTENT
        if not runs[other]:
            continue
        j = runs[other][int(rng.integers(len(runs[other])))]
        pool = np.flatnonzero(labels[j] == other)
        lo = int(rng.integers(len(pool)))
        some = pool[lo : lo + int(rng.integers(1, 9))]
        at = int(rng.integers(0, len(own) + 1))
        out[0].append("\n".join([*own[:at], *(lines[j][k] for k in some), *own[at:]]))
        out[1].append(np.concatenate([y[:at], np.full(len(some), other), y[at:]]))
    return out


def fit_texts(texts: list[str], quality: list[int]) -> LineField:
    """Lines of a text labelled 1 are content. Which lines of a text labelled 0 are boilerplate is
    not known: those that a field without transitions, fitted with all of them as boilerplate, still
    calls so, or all where it finds none. The field is fitted on the texts and on as many mixed ones."""
    feats = line_features(x := read_lines(texts))
    counts = np.bincount(x.doc, minlength=len(texts))
    bad = np.array([not q for q in quality])[x.doc]
    alone = fit_field(feats, counts, bad.astype(np.int64), steps=60, chain=False)
    found = viterbi(feats @ alone.emit, counts, alone)
    some = np.bincount(x.doc, found == BOILERPLATE, minlength=len(texts))[x.doc] > 0
    labels = np.where(bad & (found == BOILERPLATE) | bad & ~some, BOILERPLATE, CONTENT)
    more, more_labels = mixed_sequences(texts, np.split(labels, np.cumsum(counts)[:-1]))
    m = read_lines(more)
    return fit_field(np.concatenate([feats, line_features(m)]), np.concatenate([counts, np.bincount(m.doc, minlength=len(more))]), np.concatenate([labels, *more_labels]))


def learn_field(docs: DataFrame, labels: DataFrame, *, label_col: str = "quality", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> LineField | None:
    """None without labels of both kinds."""
    known = agreed_labels(labels, "doc_id", label_col)
    ids = known.select("label", F.xxhash64(F.lit("pick"), "doc_id").alias("h"), "doc_id")
    place = 1 + F.pmod(F.xxhash64(F.lit("place"), "doc_id"), F.greatest(F.lit(1), F.length("text") - sample_chars + 1)).cast("int")
    part = docs.where(F.length("text") > 0).select("doc_id", F.col("text").substr(place, F.lit(sample_chars)).alias("text"))
    # Ids are chosen before any text is read: a few times ``sample`` of each label travel to the tasks.
    got = hash_sample(ids, sample, count_labels(known), lambda near: part.join(F.broadcast(near), "doc_id").select("label", "h", "text"))
    rows = [(r["text"], y) for y in (1, 0) for r in got.get(y, [])]
    if len({y for _, y in rows}) < 2:
        return None
    return fit_texts([t for t, _ in rows], [y for _, y in rows])


def judge_texts(texts: list[str], field: LineField | None, *, min_words: int = MIN_WORDS, max_repeated: int = MAX_REPEATED, min_content: float = MIN_CONTENT) -> dict[str, np.ndarray]:
    n = len(texts)
    x = read_lines(texts)
    total = lambda v: per_text(x.doc, v, n)
    n_words, n_repeat = total(x.words), np.array([repeated_words(t)[0] for t in texts], np.int64)
    chars = total(x.of("start"))
    if field is None:
        content = chars
    else:
        label = viterbi(line_features(x) @ field.emit, np.bincount(x.doc, minlength=n), field)
        content = total(x.of("start") * (label == CONTENT))
    share = content / np.maximum(chars, 1)
    failed = (n_words < min_words) | (100 * n_repeat > max_repeated * n_words)
    return {
        "n_words": n_words,
        "word_chars": total(x.of("start") - x.of("blank")),
        "n_symbols": total(x.of("symbol")),
        "n_dup_lines": total(x.repeated),
        "n_repeat_words": n_repeat,
        "base_failed": failed,
        "kept": ~failed & (share >= min_content),
        "content_share": share,
    }


RESULT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def judge_quality(docs: DataFrame, field: LineField | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id, counts, verdict and share of content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in text_groups(batch.column(1)):
                got = judge_texts(texts, field)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), *map(pa.array, got.values())], names=[id_col, *got])
                lo += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {RESULT}")


def op8_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    field = learn_field(docs, labels.select("doc_id", "quality"))
    return judge_quality(docs, field)


QUERIES = {"op8_quality_crf": op8_quality_crf}
