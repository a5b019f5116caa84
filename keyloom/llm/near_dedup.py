"""MinHash near-dedup with sequential Bayesian verification.

Texts become sets of hashed word shingles, in Arrow batches. Equal sets form classes at once; only
a class's smallest doc_id goes on. Banded MinHash signatures put it into buckets. A bucket never
yields all its pairs: the first few members of every bucket (in one order for all buckets, those in
the fullest buckets first, so that copies meet what they were made from) are compared with the
bucket's members of other components, then leave it, and a large group of near copies collapses.

What still shares a bucket across components is mostly unlike texts around a common passage. These
documents are bucketed anew, by the rarest of their own shingles: with all shingles in one order of
rising frequency, two sets of similarity t share one among the first (1 - t) n + 1 of each, and the
first that they share leaves room for the overlap that t needs. Both conditions are exact, so no
link is lost, and a common passage stands too far back to make a pair. Rounds of 16, 64 and so on go
over these buckets until none spans two components. Every pair that shares a bucket is so either
compared, ruled out exactly or already connected, which is all that components need.

The worst case is a bucket of m sets that are unlike and yet share a rare shingle with room for the
overlap: its m (m - 1) / 2 pairs are all compared, in rounds, as no bound rules them out. A pair is
two signatures of 660 bytes in such a round. The joins on buckets are ones whose hot side Spark can
split while it runs.

A pair is verified in steps: signatures are compared in batches of 32 hashes, and the pair is
dropped once the posterior probability (uniform prior) that its similarity reaches the threshold
falls below ``MISS``; survivors are verified exactly on their full sets.

A text without words has no shingles and is linked with nothing. A repeated doc_id is one document
whose rows are linked; a null doc_id is linked with nothing, has a null component and is kept.
Columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.components import connected_components
from keyloom.llm.scratch import cut
from keyloom.llm.text import at_blanks
from keyloom.sources import read_table

SHINGLE = 5
THRESHOLD = 80  # percent
ROWS = 5
#: Chance that a pair right at the threshold shares no bucket, and that a batch drops it.
MISS = 3e-6
BATCH = 32
FIRST_PIVOTS = 4

_U = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def n_bands(threshold: int = THRESHOLD, rows: int = ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - (threshold / 100) ** rows))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _odd(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased."""

    STRIDE = 1 << 16

    def __init__(self, size: int):
        self.size = size
        self.byte = _odd(1, 256)
        self.place = np.cumprod(np.full(self.STRIDE, 0xD1342543DE82EF95, _U))
        self.weight = _odd(2, size)
        self.short = _odd(3, size + 1)

    def _words(self, b: np.ndarray) -> np.ndarray:
        """A hash of each word: the sum of its bytes' codes, each times its place within the word."""
        blank = _BLANK[b]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        if not len(start):
            return np.zeros(0, _U)
        length = end - start
        within = np.arange(len(b)) - np.repeat(np.concatenate([[0], start]), np.diff(np.concatenate([[0], start, [len(b)]])))
        place = self.place
        if length.max() > len(place):
            place = np.cumprod(np.full(int(length.max()), place[0], _U))
        codes = self.byte[b] * place[np.minimum(within, len(place) - 1)]
        codes[blank] = 0
        return mix(np.add.reduceat(codes, start) + length.astype(_U))

    def hashes(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode("utf-8", "replace").lower()
        w = np.concatenate([self._words(np.frombuffer(part, np.uint8)) for part in at_blanks(raw, 16 * self.STRIDE)])
        if not len(w):
            return w
        if len(w) < self.size:
            return mix((w * self.weight[: len(w)]).sum(keepdims=True) + self.short[len(w)])
        n = len(w) - self.size + 1
        s = w[:n] * self.weight[0]
        for k in range(1, self.size):
            s += w[k : k + n] * self.weight[k]
        return np.unique(mix(s))


class Signer:
    def __init__(self, hashes: int):
        self.factor = _odd(4, hashes)
        self.band = _odd(5, ROWS)

    def sign(self, s: np.ndarray) -> np.ndarray:
        least = np.full(len(self.factor), np.iinfo(_U).max, _U)
        for lo in range(0, len(s), 256):
            np.minimum(least, (s[lo : lo + 256, None] * self.factor).min(0), out=least)
        return (least >> _U(32)).astype(np.uint32)

    def bands(self, sig: np.ndarray) -> np.ndarray:
        b = sig.reshape(-1, ROWS).astype(_U)
        return mix((b * self.band).sum(1) + _odd(6, len(b)))


def _summaries(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """(doc_id, n_shingles, f1, f2, bands): the set's size, 128-bit fingerprint and bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(size), Signer(bands * ROWS)
        for batch in batches:
            n, prints, keys, offsets = [], [], [], [0]
            for text in batch.column(1):
                s = shingler.hashes(text.as_py())
                n.append(len(s))
                prints.append((mix(s).sum(), mix(s ^ _U(0x5851F42D4C957F2D)).sum()))
                if len(s):
                    keys.append(signer.bands(signer.sign(s)))
                offsets.append(offsets[-1] + (bands if len(s) else 0))
            f = np.array(prints, _U).reshape(-1, 2).view(np.int64)
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat))],
                names=["doc_id", "n_shingles", "f1", "f2", "bands"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, f1 long, f2 long, bands array<long>")


def _full(docs: DataFrame, size: int, bands: int) -> DataFrame:
    """(id, sig, shingles): signatures and full sets, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer = Shingler(size), Signer(bands * ROWS)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                sets = [shingler.hashes(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([signer.sign(s).tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "sig", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, f"id {docs.schema['doc_id'].dataType.simpleString()}, sig binary, shingles binary")


def least_matches(n: int, threshold: int, miss: float) -> int:
    """The fewest of ``n`` equal hashes with which P(similarity >= threshold) is ``miss`` or more.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1), whose upper tail at t is the
    chance of at most m successes in n + 1 trials of chance t.
    """
    t, tail = threshold / 100, 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


def _promising(pairs: DataFrame, full: DataFrame, threshold: int, miss: float, hashes: int) -> DataFrame:
    """The pairs that no signature batch drops."""
    steps = [(n, least_matches(n, threshold, miss)) for n in [*range(BATCH, hashes, BATCH), hashes]]
    sig = full.select("id", "sig")
    both = pairs.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint32).reshape(batch.num_rows, -1) for k in (2, 3))
            rows, same, done = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:
                same[rows] += (sa[rows, done:n] == sb[rows, done:n]).sum(1)
                rows, done = rows[same[rows] >= least], n
            yield pa.RecordBatch.from_arrays([batch.column(k).take(pa.array(rows)) for k in (0, 1)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _linked(pairs: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold."""
    own = full.select("id", "shingles")
    both = pairs.join(own.select(F.col("id").alias("a"), F.col("shingles").alias("xa")), "a").join(own.select(F.col("id").alias("b"), F.col("shingles").alias("xb")), "b").select("a", "b", "xa", "xb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_py(), _U), np.frombuffer(y.as_py(), _U)
                shared = 0
                if 100 * min(len(p), len(q)) >= threshold * max(len(p), len(q)):
                    shared = len(p) + len(q) - len(np.union1d(p, q))
                keep.append(100 * shared >= threshold * (len(p) + len(q) - shared))
            rows = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column(k).take(rows) for k in (0, 1)], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}")


def _rare_entries(entries: DataFrame, full: DataFrame, threshold: int) -> DataFrame:
    """(key, id, w, n, pos) for the ids of ``entries``: the shingles of the front part of each set,
    rarest first, that another id has there too; pos is a shingle's place in its set."""
    ids = cut(entries.select("id", "w").distinct(), "rest")
    kind = full.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 50):
                part = batch.slice(lo, 50)
                sets = [np.frombuffer(x.as_py(), np.int64) for x in part.column(2)]
                n = np.array([len(x) for x in sets], np.int64)
                at = pa.array(np.repeat(np.arange(len(sets)), n))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), pa.array(np.repeat(n, n)), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))], names=["id", "w", "n", "key"])

    own = full.join(ids, "id").select("id", "w", "shingles").mapInArrow(run, f"id {kind}, w long, n long, key long")
    own = cut(own, "shingles")
    often = own.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    each = Window.partitionBy("id")
    place = F.col("n") - F.count(F.lit(1)).over(each) + F.row_number().over(each.orderBy("df", "key")) - 1  # those of one id only come first
    front = own.join(often, "key").withColumn("pos", place.cast("long"))
    front = cut(front.where((100 - threshold) * F.col("n") >= 100 * F.col("pos")), "front")
    # Of shingles that the same ids have, the first in order stands for all.
    seen = front.groupBy("key", "df").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y")).where("m > 1")
    first = seen.groupBy("m", "x", "y").agg(F.min(F.struct("df", "key")).alias("best")).select(F.col("best.key").alias("key"))
    front = front.join(first, "key", "left_semi")
    # An id stays where the smallest set and the most room of a bucket leave it a partner.
    bounds = front.groupBy("key").agg(F.min("n").alias("least"), F.max(F.col("n") - F.col("pos")).alias("most"))
    room = F.least(F.col("n") - F.col("pos"), F.col("most"))
    partner = F.greatest(threshold * F.col("n"), 100 * F.col("least"))  # a partner's size, in hundredths
    fits = room * 100 * (100 + threshold) >= threshold * (100 * F.col("n") + partner)
    return front.join(bounds, "key").where(fits).select("key", "id", "w", "n", "pos")


def _components(entries: DataFrame, links: DataFrame, full: DataFrame, threshold: int, miss: float, hashes: int) -> tuple[DataFrame, DataFrame]:
    """(id, comp) for ids of ``entries`` (key, id, w, n, pos) and of ``links`` (a, b), which hold from the start, and all links found."""
    comps = entries.select("id").union(links.select(F.col("a").alias("id"))).union(links.select(F.col("b").alias("id"))).distinct()
    comps = cut(comps.withColumn("comp", F.col("id")), "comps")
    entries = cut(entries.withColumn("comp", F.col("id")), "entries")
    tested, found, pivots_each, rare = None, links, FIRST_PIVOTS, False
    order = F.row_number().over(Window.partitionBy("key").orderBy(F.col("w").desc(), F.xxhash64(F.lit("pivot"), "id")))
    while True:
        if not links.isEmpty():
            joined = links.join(comps.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(comps.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b")
            moved = connected_components(joined.select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b").distinct())
            moved = moved.withColumnRenamed("id", "comp")
            comps = cut(comps.join(moved, "comp", "left").select("id", F.coalesce("label", "comp").alias("comp")), "comps")
            entries = entries.join(moved, "comp", "left").select("key", "id", "w", "n", "pos", F.coalesce("label", "comp").alias("comp"))
        live = entries.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        entries = cut(entries.join(live, "key", "left_semi"), "entries")
        if entries.isEmpty():
            return comps, found
        if tested is not None and not rare:
            entries, links, rare = _rare_entries(entries, full, threshold).join(comps, "id"), links.limit(0), True
            continue
        pivots = cut(entries.withColumn("nth", order).where(F.col("nth") <= pivots_each).select("key", F.col("id").alias("pivot"), F.col("comp").alias("pivot_comp"), F.col("n").alias("pivot_n"), F.col("pos").alias("pivot_pos")), "pivots")
        room = F.least(F.col("n") - F.col("pos"), F.col("pivot_n") - F.col("pivot_pos"))  # the most that they can share
        pairs = entries.join(pivots, "key").where("comp <> pivot_comp").where(room * (100 + threshold) >= threshold * (F.col("n") + F.col("pivot_n"))).select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs, "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = cut(_linked(_promising(pairs, full, threshold, miss, hashes), full, threshold), "links")
        found = found.union(links)
        entries = entries.join(pivots.select("key", F.col("pivot").alias("id")), ["key", "id"], "left_anti")
        pivots_each *= 4


def near_duplicates(docs: DataFrame, *, size: int = SHINGLE, threshold: int = THRESHOLD, miss: float = MISS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, class_id, n_links) for every row of ``docs``.

    class_id is the smallest doc_id with the same set; n_links counts the classes that the class
    was found linked with on the way to its component.
    """
    bands = n_bands(threshold, ROWS, miss)
    docs = docs.select("doc_id", "text")
    rows = cut(_summaries(docs, size, bands), "summaries")
    some = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(some.groupBy("f1", "f2").agg(F.min("doc_id").alias("class_id")), "classes")
    heads = some.join(classes.select(F.col("class_id").alias("doc_id"), F.col("f1").alias("g1"), F.col("f2").alias("g2")), "doc_id").where("f1 = g1 AND f2 = g2")
    spread = heads.select(F.explode("bands").alias("key"), F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"))
    # Of buckets with the same members, as a few copies share in many bands, one is enough.
    members = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "id")).alias("y"))
    shared = spread.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), *members).where("lo < hi")
    shared = shared.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", F.col("n").alias("size"))
    entries = cut(spread.join(shared, "key").distinct(), "entries")
    # The text that copies were made from shares the fullest buckets: it is to be met first.
    weight = entries.groupBy("id").agg(F.sum("size").alias("w"))
    entries = cut(entries.join(weight, "id").select("key", "id", "w", "n", F.lit(0).cast("long").alias("pos")), "entries")
    need = weight.select(F.col("id").alias("doc_id"))
    full = cut(_full(docs.join(need.hint("shuffle_hash"), "doc_id", "left_semi"), size, bands), "sets")
    member = rows.select("doc_id", "n_shingles", "f1", "f2").join(classes, ["f1", "f2"], "left")
    member = cut(member.select("doc_id", "n_shingles", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "members")
    own = member.where("class_id IS NOT NULL").groupBy("doc_id").agg(F.min("class_id").alias("a"), F.collect_set("class_id").alias("all")).where(F.size("all") > 1)
    same = own.select("a", F.explode("all").alias("b")).where("a <> b")
    comps, links = _components(entries, same, full, threshold, miss, bands * ROWS)
    ends = links.select(F.col("a").alias("class_id")).union(links.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    facts = comps.select(F.col("id").alias("class_id"), "comp").join(ends, "class_id", "left")
    out = member.join(facts, "class_id", "left")
    component = F.coalesce("comp", "class_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), size=4).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words
), rows_ AS (SELECT doc_id, unnest(s) AS x FROM sets),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
pairs AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM rows_ p JOIN rows_ q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * k >= 80 * (sa.n + sb.n - k)
), edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, r) AS (SELECT doc_id, doc_id FROM sizes UNION SELECT reach.id, edges.b FROM reach JOIN edges ON reach.r = edges.a)
SELECT sizes.doc_id, n::BIGINT AS n_shingles, min(r) AS component_id, sizes.doc_id = min(r) AS kept
FROM sizes JOIN reach ON reach.id = sizes.doc_id GROUP BY sizes.doc_id, n
"""

QUERIES = {"op4_near_dedup": op4_near_dedup}
ORACLES = {"op4_near_dedup": ORACLE}
