"""Quality classifier: Bradley-Terry ranking from preference pairs.

Each text becomes a row of counts and shares, computed in Arrow batches and stored once. A bounded
sample of labelled rows (``SAMPLE`` of each label, by hash order) gives preference pairs, a row of
label 1 preferred to one of label 0; weights are learned by logistic loss on feature differences.
The threshold is a quantile of all documents' scores: of ``LEVELS`` quantiles, that with the fewest
errors on all labelled rows that may be learned from. score is the logistic of the distance to it.

A null text is an empty one; a long one is read line by line in strides. Columns other than the id
and the text are not read. Labels that contradict each other for one id, null labels and null
ids are not learned from; without labels of both kinds every score is 0.5. Repeated rows each get
their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.linefeat import per_text, read_lines, repeated_words
from keyloom.llm.sampling import agreed_labels, count_labels, hash_sample
from keyloom.llm.scratch import cut
from keyloom.llm.text import fold, text_groups
from keyloom.sources import read_table

SAMPLE = 4000
PAIRS = 60_000
LEVELS = 1000


def text_features(texts: list[str]) -> np.ndarray:
    """One row for each text; every value is within a few units of 0."""
    n = len(texts)
    lines = read_lines(texts)
    tot = {k: per_text(lines.doc, lines.of(k), n) for k in ("blank", "symbol", "pipe", "upper", "digit", "bang", "stop", "other_mark", "start")}
    words = per_text(lines.doc, lines.words, n)
    rep = np.array([repeated_words(t) for t in texts]).reshape(-1, 2)
    chars = np.maximum(tot["start"] - tot["blank"], 1)
    w = np.maximum(words, 1)
    odd = (lines.share("symbol") > 0.03) | (lines.share("upper") > 0.4) | (lines.share("bang") > 0.04)
    odd_chars = per_text(lines.doc, lines.of("start") * odd, n)
    n_lines = np.bincount(lines.doc, minlength=n)
    share = {k: tot[k] / chars for k in ("symbol", "pipe", "upper", "digit", "bang", "stop", "other_mark")}
    cols = [
        np.log1p(words) / 4,
        np.minimum(words, 20) / 20,
        *share.values(),
        *(np.sqrt(share[k]) for k in ("symbol", "pipe", "upper", "digit", "bang", "other_mark")),
        *((share[k] > low).astype(float) for k, low in (("symbol", 0.01), ("symbol", 0.05), ("upper", 0.3), ("bang", 0.01), ("pipe", 0.01))),
        odd_chars / np.maximum(tot["start"], 1),
        chars / w / 10,
        np.minimum(tot["stop"] / w, 2),
        rep[:, 0] / w,
        rep[:, 1] / w,
        per_text(lines.doc, lines.repeated, n) / n_lines,
        np.minimum(w / n_lines, 100) / 100,
    ]
    return np.stack(cols, 1).astype(np.float32)


def feature_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, feats array<float>) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in text_groups(batch.column(1)):
                x = text_features(texts)
                flat = pa.array(x.ravel(), pa.float32())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, len(texts)), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), flat)], names=[id_col, "feats"])
                lo += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, feats array<float>")


def fit_pairs(good: np.ndarray, bad: np.ndarray, *, pairs: int = PAIRS, steps: int = 600, penalty: float = 1e-4, seed: int = 11) -> np.ndarray:
    """Weights w with sigmoid(w (x_good - x_bad)) near 1 over random pairs."""
    rng = np.random.default_rng(seed)
    scale = np.concatenate([good, bad]).std(0) + 1e-6
    d = (good[rng.integers(0, len(good), pairs)] - bad[rng.integers(0, len(bad), pairs)]) / scale
    w, m, v = (np.zeros(d.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        part = d[rng.integers(0, pairs, 4096)]
        g = -(part * (1 / (1 + np.exp(np.clip(part @ w, -30, 30))))[:, None]).mean(0) + penalty * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * min(1, 2 - 2 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w / scale


def raw_scores(feats: DataFrame, weights: np.ndarray, *, id_col: str = "doc_id") -> DataFrame:
    """(id, raw): the weighted sum of each row's features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x.astype(np.float64) @ weights)], names=[id_col, "raw"])

    kind = feats.schema[id_col].dataType.simpleString()
    return feats.select(id_col, "feats").mapInArrow(run, f"`{id_col}` {kind}, raw double")


def count_by_level(seen: DataFrame, levels: np.ndarray) -> np.ndarray:
    """(2, levels + 1): rows (label, raw) of each label with so many levels at or below raw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                code = np.searchsorted(levels, batch.column(1).to_numpy(), "right") * 2 + batch.column(0).to_numpy()
                found, n = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["code", "n"])

    rows = seen.select(F.col("label").cast("long"), "raw").mapInArrow(run, "code long, n long")
    count = np.zeros((2, len(levels) + 1))
    for r in rows.groupBy("code").agg(F.sum("n").alias("n")).collect():  # 2 * LEVELS rows at most
        count[r["code"] % 2, r["code"] // 2] = r["n"]
    return count


def best_cut(levels: np.ndarray, count: np.ndarray) -> float:
    """The level, or the place between it and the one below, with the fewest errors."""
    # Threshold at levels[k]: rows with k levels or fewer at or below them fall below it.
    errors = np.cumsum(count[1])[:-1] + count[0].sum() - np.cumsum(count[0])[:-1]
    best = np.flatnonzero(errors == errors.min())
    best = best[len(best) // 2]
    below = levels[best - 1] if best else levels[0]
    return float((levels[best] + below) / 2)


def score_quality(feats: DataFrame, labels: DataFrame, learn: Column, *, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(id, score, predicted) for every row of ``feats``, a stored table; ``learn``: which ids may be learned from."""
    known = agreed_labels(labels.where(F.coalesce(learn, F.lit(False))), id_col, label_col)
    with_hash = known.select("label", F.xxhash64(F.lit("pick"), id_col).alias("h"), id_col)
    got = hash_sample(with_hash, sample, count_labels(known), lambda near: feats.join(F.broadcast(near), id_col).select("label", "h", "feats"))  # near: a few times ``sample`` ids
    good, bad = (np.array([r["feats"] for r in got.get(y, [])], np.float64) for y in (1, 0))
    if not len(good) or not len(bad):
        return feats.select(id_col, F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    scores = cut(raw_scores(feats, fit_pairs(good, bad), id_col=id_col), "scores")
    levels = scores.select(F.percentile_approx("raw", [k / LEVELS for k in range(1, LEVELS)], 20_000).alias("q")).first()["q"]
    levels = np.unique(np.array(levels, np.float64))
    cut_at = best_cut(levels, count_by_level(known.join(scores, id_col), levels))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("raw") - cut_at))))
    return scores.select(id_col, score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op10_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    feats = cut(feature_rows(docs), "features")
    scored = score_quality(feats, labels.select("doc_id", "quality"), fold(F.col("doc_id"), 3) != 1)
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {"op10_quality_rank": op10_quality_rank}
