"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy.

A text's lower-cased UTF-8 bytes are read in segments of 64. In each direction a gated recurrent
unit with one gate (a blend of its state and a candidate state) runs over the segment; every byte
gets class probabilities from both states, and a document's probabilities are their mean over all
of its bytes. Training is backpropagation through time on the driver, on a bounded sample of
labelled rows: ``SAMPLE_PER_LANG`` rows of each language by hash order, ``SAMPLE_CHARS`` characters
of each from a place that a hash chooses. Prediction runs in Arrow batches over whole texts.

A null text, or one without a letter, is "und" with score 0. Rows whose lang or id is null are
not learned from. Equal texts get equal predictions. Without any labelled row every text is "und".
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.sampling import count_labels, hash_sample
from keyloom.llm.text import fold, text_groups
from keyloom.sources import read_table

SAMPLE_PER_LANG = 300
SAMPLE_CHARS = 1500
SEGMENT = 64
HIDDEN = 8
PAD = 0xFF  # never a byte of UTF-8
UND = "und"
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LangModel:
    langs: list[str]
    embed: np.ndarray  # (2 directions, 2 * hidden, 256): gate rows, then candidate rows
    recur: np.ndarray  # (2, 2 * hidden, hidden)
    out: np.ndarray  # (2, langs, hidden)
    bias: np.ndarray  # (langs,)


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n, SEGMENT) bytes of all texts, and how many segments each text has."""
    parts, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        raw = text.lower().encode("utf-8", "replace")
        counts[i] = n = -(-len(raw) // SEGMENT)
        parts += [raw, b"\xff" * (n * SEGMENT - len(raw))]
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SEGMENT), counts


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(x: np.ndarray, embed: np.ndarray, recur: np.ndarray, hidden: int) -> list[tuple]:
    h, steps = np.zeros((hidden, x.shape[1]), np.float32), []
    for row in x:
        pre = embed[:, row] + recur @ h
        gate, cand = _sigmoid(pre[:hidden]) * (row != PAD), np.tanh(pre[hidden:])
        steps.append((h, gate, cand))
        h = h + gate * (cand - h)
    return [*steps, (h, None, None)]


def _backward(x: np.ndarray, steps: list[tuple], dh_out: list[np.ndarray], recur: np.ndarray, hidden: int) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of embed and recur; dh_out: what the outputs ask of the state after each step."""
    d_embed, d_recur = np.zeros((256, 2 * hidden), np.float32), np.zeros_like(recur)
    dh = np.zeros_like(steps[0][0])
    for t in range(len(x) - 1, -1, -1):
        dh = dh + dh_out[t]
        h, gate, cand = steps[t]
        d_gate, d_cand = dh * (cand - h) * gate * (1 - gate), dh * gate * (1 - cand * cand)
        d_pre = np.concatenate([d_gate, d_cand])
        d_recur += d_pre @ h.T
        order = np.argsort(x[t], kind="stable")
        seen, first = np.unique(x[t][order], return_index=True)
        d_embed[seen] += np.add.reduceat(d_pre.T[order], first, axis=0)
        dh = dh * (1 - gate) + recur.T @ d_pre
    return d_embed.T, d_recur


def train(texts: list[str], labels: list[str], *, hidden: int = HIDDEN, steps: int = 350, batch: int = 256, rate: float = 0.02, seed: int = 7) -> LangModel:
    """Cross-entropy at every byte, Adam, gradients through all the steps of a segment."""
    langs = sorted(set(labels))
    segs, counts = segments(texts)
    y = np.repeat(np.array([langs.index(v) for v in labels], np.int64), counts)
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.3, (2, 2 * hidden, 256)).astype(np.float32),
        "recur": rng.normal(0, 0.3, (2, 2 * hidden, hidden)).astype(np.float32),
        "out": rng.normal(0, 0.3, (2, len(langs), hidden)).astype(np.float32),
        "bias": np.zeros(len(langs), np.float32),
    }
    moment, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    by_class = [np.flatnonzero(y == k) for k in range(len(langs))]
    if any(len(c) == 0 for c in by_class):
        by_class = [c for c in by_class if len(c)]
    for step in range(1, steps + 1 if by_class else 0):
        pick = np.concatenate([rng.choice(c, max(1, batch // len(by_class))) for c in by_class])
        x, want = segs[pick].T, y[pick]
        ahead, back = _forward(x, p["embed"][0], p["recur"][0], hidden), _forward(x[::-1], p["embed"][1], p["recur"][1], hidden)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        asks_ahead, asks_back = [None] * SEGMENT, [None] * SEGMENT
        n = max(1, int((x != PAD).sum()))
        for t in range(SEGMENT):
            hf, hb = ahead[t + 1][0], back[SEGMENT - t][0]
            z = p["out"][0] @ hf + p["out"][1] @ hb + p["bias"][:, None]
            e = np.exp(z - z.max(0))
            e /= e.sum(0)
            e[want, np.arange(len(want))] -= 1
            e *= (x[t] != PAD) / np.float32(n)
            grad["out"][0] += e @ hf.T
            grad["out"][1] += e @ hb.T
            grad["bias"] += e.sum(1)
            asks_ahead[t], asks_back[SEGMENT - 1 - t] = p["out"][0].T @ e, p["out"][1].T @ e
        grad["embed"][0], grad["recur"][0] = _backward(x, ahead, asks_ahead, p["recur"][0], hidden)
        grad["embed"][1], grad["recur"][1] = _backward(x[::-1], back, asks_back, p["recur"][1], hidden)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        now = rate * min(1.0, 2 - 2 * step / steps)
        for k, g in grad.items():
            g *= min(1.0, 1.0 / (norm + 1e-9))
            moment[k] = 0.9 * moment[k] + 0.1 * g
            square[k] = 0.99 * square[k] + 0.01 * g * g
            p[k] = p[k] - (now * (moment[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return LangModel(langs, **p)


class Reader:
    """Class probabilities of texts. Both functions of a step come from one exponential: the
    tables are scaled so that 1 / (1 + exp(.)) is the gate, and half of 1 + the candidate."""

    WIDTH = 1024

    def __init__(self, m: LangModel):
        self.hidden = hidden = m.recur.shape[2]
        scale = np.concatenate([-np.ones(hidden), np.full(hidden, -2.0)]).astype(np.float32)[:, None]
        self.embed = [np.ascontiguousarray(e * scale) for e in m.embed]
        for e in self.embed:
            e[:hidden, PAD], e[hidden:, PAD] = 60, 0  # the gate is shut
        self.recur = [np.ascontiguousarray(u * scale) for u in m.recur]
        self.out, self.bias = [np.ascontiguousarray(o) for o in m.out], m.bias
        self.langs = m.langs

    def _block(self, x: np.ndarray) -> np.ndarray:
        """x: (SEGMENT, b) bytes; sums over positions of the class probabilities, (langs, b)."""
        hid, b = self.hidden, x.shape[1]
        z = np.empty((SEGMENT, len(self.langs), b), np.float32)
        z[:] = self.bias[:, None]
        g, r, o = np.empty((2 * hid, b), np.float32), np.empty((2 * hid, b), np.float32), np.empty((len(self.langs), b), np.float32)
        for d, places in ((0, range(SEGMENT)), (1, range(SEGMENT - 1, -1, -1))):
            h = np.zeros((hid, b), np.float32)
            for t in places:
                np.dot(self.recur[d], h, out=r)
                np.take(self.embed[d], x[t], axis=1, out=g, mode="clip")
                g += r
                np.exp(g, out=g)
                g += 1
                np.reciprocal(g, out=g)
                cand = g[hid:]
                cand *= 2
                cand -= 1
                cand -= h
                cand *= g[:hid]
                h += cand
                np.dot(self.out[d], h, out=o)
                z[t] += o
        np.exp(z, out=z)  # states are within (-1, 1), so this is bounded
        share = np.reciprocal(np.einsum("tlb->tb", z)) * (x != PAD)
        return np.einsum("tlb,tb->lb", z, share)

    def probabilities(self, texts: list[str]) -> np.ndarray:
        segs, counts = segments(texts)
        sums = np.zeros((len(segs), len(self.langs)))
        with np.errstate(over="ignore"):
            for lo in range(0, len(segs), self.WIDTH):
                part = segs[lo : lo + self.WIDTH]
                sums[lo : lo + self.WIDTH] = self._block(part.T.astype(np.intp)).T
        ends = np.concatenate([[0], np.cumsum(counts)])
        total = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(sums, axis=0)])[ends]
        doc = np.maximum(np.diff(total, axis=0), 0)
        return doc / np.maximum(doc.sum(1, keepdims=True), 1e-12)


def sample_labelled(docs: DataFrame, learn: Column, *, per_lang: int = SAMPLE_PER_LANG, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[str]]:
    """A bounded sample of labelled texts, ``per_lang`` of each language, in hash order of the id."""
    place = 1 + F.pmod(F.xxhash64(F.lit("place"), id_col), F.greatest(F.lit(1), F.length(text_col) - chars + 1)).cast("int")
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    rows = known.select(F.col(lang_col).cast("string").alias("label"), F.xxhash64(F.lit("pick"), id_col).alias("h"), F.col(text_col).substr(place, F.lit(chars)).alias("text"))
    got = hash_sample(rows, per_lang, count_labels(rows.select("label")), lambda near: near.where(F.col("text").rlike(r"\p{L}")))
    return [r["text"] for lang in sorted(got) for r in got[lang]], [lang for lang in sorted(got) for _ in got[lang]]


def identify(docs: DataFrame, model: LangModel, *, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added, in place of columns of these names; every other
    column stays as it was."""
    docs = docs.drop("lang_pred", "score")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model) if model.langs else None
        for batch in batches:
            pred, score = np.full(batch.num_rows, UND, object), np.zeros(batch.num_rows)
            lo = 0
            for texts in text_groups(batch.column(at)) if reader else ():
                own = np.array([i for i, t in enumerate(texts) if _LETTER.search(t)], np.int64)
                if len(own):
                    p = reader.probabilities([texts[i] for i in own])
                    pred[lo + own], score[lo + own] = np.array(model.langs, object)[p.argmax(1)], np.clip(p.max(1), 0, 1)
                lo += len(texts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{schema}, lang_pred string, score double")


def learn_languages(docs: DataFrame) -> LangModel:
    """From the rows of ``docs`` outside fold 2 of 4."""
    texts, labels = sample_labelled(docs, fold(F.col("doc_id"), 4) != 2)
    return train(texts, labels)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn_languages(docs)
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out, "lang_pred", "score")


QUERIES = {"op9_language_id": op9_language_id}
