"""Best-fit packing of token pieces by exact-complement hashing.

Texts are tokenized once, in Arrow batches, into a small table of pieces (length, place, checksum)
that is written to the shared folder. What is packed is the histogram of lengths, which has at most
``capacity`` entries however large the corpus is: for each length, from the longest, single, pair
and triple sums of the available lengths that equal the gap exactly are consumed as often as their
counts allow; what is left is placed best-fit, longest first. The result is a list of fillings with
multiplicities, again bounded by the capacity. Spark then numbers the pieces of each length, in
buckets so that a very common length is many tasks' work, and each piece finds its place by its
number.

A null text has no tokens but the end mark. Repeated rows are packed each on its own; a null
doc_id stays null. Columns other than ``id_col`` and ``text_col`` are not read.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keyloom.llm.scratch import cut
from keyloom.llm.tokens import ChunkTokenizer
from keyloom.sources import read_table

CAPACITY = 2048
#: Pieces that one task numbers, about.
BUCKET_ROWS = 100_000


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int | None = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32): each text's ids, then ``end_id``, cut at ``capacity``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer.shared(tokenizer_path)
        end = b"" if end_id is None else end_id.to_bytes(4, "little")
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            at = []
            for row, ids in enumerate(i for lo in range(0, batch.num_rows, 50) for i in tok.many([t or "" for t in batch.column(1).slice(lo, 50).to_pylist()])):
                buf = memoryview(ids + end)
                for piece, lo in enumerate(range(0, len(buf), 4 * capacity)):
                    part = buf[lo : lo + 4 * capacity]
                    at.append(row)
                    for c, v in zip(cols[1:], (piece, lo // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], names=[id_col, "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long")


def _pair(have: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Available lengths a >= b with a + b = total, a as large as can be, at most ``most``."""
    lo, hi = (total + 1) // 2, min(total - 1, most)
    if lo > hi:
        return None
    both = np.flatnonzero(have[lo : hi + 1] & have[total - hi : total - lo + 1][::-1])
    return (int(lo + both[-1]), int(total - lo - both[-1])) if len(both) else None


def _complement(have: np.ndarray, gap: int, most: int) -> Iterator[tuple[int, ...]]:
    """Single, pair and triple sums of available lengths that fill ``gap`` exactly."""
    if gap <= most and have[gap]:
        yield (gap,)
    if p := _pair(have, gap, most):
        yield p
    for a in np.flatnonzero(have[(gap + 2) // 3 : min(gap - 2, most) + 1])[::-1] + (gap + 2) // 3:
        if p := _pair(have, gap - int(a), int(a)):
            yield (int(a), *p)


def plan_fillings(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths, times): sequences with these lengths, so many times, using up the histogram."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    done: list[tuple[list[int], int]] = []
    have = count > 0
    for length in range(capacity, 0, -1):
        if length == capacity and count[length]:
            done.append(([length], int(count[length])))
            count[length], have[length] = 0, False
        while count[length]:
            for rest in _complement(have, capacity - length, length):
                need: dict[int, int] = defaultdict(int)
                for x in (length, *rest):
                    need[x] += 1
                times = min(int(count[x]) // k for x, k in need.items())
                if times:
                    for x, k in need.items():
                        count[x] -= times * k
                        have[x] = count[x] > 0
                    done.append(([length, *rest], times))
                    break
            else:
                break
    # Best fit, longest first; open sequences are grouped by their gap.
    open_: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    some = np.zeros(capacity + 1, bool)
    for length in range(capacity, 0, -1):
        n = int(count[length])
        while n:
            fit = np.flatnonzero(some[length:])
            if not len(fit):
                per = capacity // length
                for k, times in ((per, n // per), (n % per, 1)):
                    if k and times:
                        open_[capacity - k * length].append(([length] * k, times))
                        some[capacity - k * length] = True
                break
            gap = int(fit[0]) + length
            items, times = open_[gap].pop()
            use = min(n, times)
            if use < times:
                open_[gap].append((items, times - use))
            some[gap] = bool(open_[gap])
            open_[gap - length].append(([*items, length], use))
            some[gap - length] = True
            n -= use
    return done + [x for groups in open_.values() for x in groups]


def _places(fillings: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length, first number of a run), with each run's first sequence and offset."""
    used: dict[int, int] = defaultdict(int)
    rows, seq = [], 0
    for items, times in fillings:
        offset = 0
        for x in items:
            rows.append(((x << 48) + used[x], seq - used[x], offset))
            used[x] += times
            offset += x
        seq += times
    rows.sort()
    keys, base, offset = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
    return keys, base, offset


def pack_pieces(pieces: DataFrame, *, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """``pieces`` (a stored table with a ``length``) with sequence_id and offset (long) added."""
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    keys, base, offset = _places(plan_fillings(histogram, capacity))
    buckets = sum(histogram.values()) // BUCKET_ROWS + 1
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = dealt.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_bucket", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy(*order))
    ranked = dealt.withColumn("_row", number).join(sizes, ["length", "_bucket"]).withColumn("_rank", F.col("_before") + F.col("_row") - 1)
    ranked = ranked.select(*pieces.columns, "_rank")
    names = pieces.columns
    n_cols, at = len(names), names.index("length")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(n_cols).to_numpy()
            length = batch.column(at).to_numpy()
            run = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_cols], pa.array(base[run] + rank), pa.array(offset[run])], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, *, capacity: int = CAPACITY, end_id: int | None = 0) -> DataFrame:
    """Tokenize, cut and pack: one row for each piece of ``docs``."""
    pieces = cut(tokenize_pieces(docs, tokenizer_path, capacity=capacity, end_id=end_id), "pieces")
    return pack_pieces(pieces, capacity=capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op7_packing": op7_packing}
