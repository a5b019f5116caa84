"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts and benchmark items are compared as lower-cased letters and digits with single spaces. An
item is leaked where a text holds it with at most ``EDIT_PERCENT`` percent of its characters edited;
of an item of more than ``PIECE_CHARS`` characters any passage of that length is as good as the
whole. That is one rule for all lengths: what is looked for are pieces, an item itself or the half
overlapping passages of a longer one, and what is found of one item side by side is one region.

A piece of m characters with a budget of k edits shares at least m + 1 - q - k q of its q-grams with
the region it was copied to, and all of them lie on 2 k + 1 neighbouring diagonals (place in the
text minus place in the piece). Every text's q-grams are looked up in the pieces' q-gram index; hits
are counted in overlapping bands of diagonals, each wide enough that some band holds the whole
run; bands that meet the bound are verified by alignment within the band. q is 8, or 4 for the few
short pieces whose bound would not be positive at 8, so every piece has its full budget.

Items are dealt to blocks of about ``BLOCK_CHARS`` characters by a hash of their pieces. One block is
broadcast; more are written by Spark to the shared folder, one file each, which Spark's own file
distribution brings to the executors' disks. A task reads its texts once: it gathers about
``GROUP_CHARS`` characters of them and opens one block after the other for these, so a worker holds
one index whatever the benchmark's size, and nothing of a large benchmark passes through the driver.

Items of fewer than ``MIN_CHARS`` normalized characters are no evidence of a leak, as any text may
hold them, and are skipped, as null ones are; a null text holds nothing. A very long text is read in
strides. Repeated rows give repeated results. Columns other than the ids and texts are not read.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from keyloom.llm.scratch import forget_at_end, shared_dir
from keyloom.llm.text import text_groups
from keyloom.sources import read_table

GRAMS = (8, 4)
EDIT_PERCENT = 10
PIECE_CHARS = 400
MIN_CHARS = 8
BLOCK_CHARS = 1_000_000
#: Characters of texts that meet one block after the other.
GROUP_CHARS = 1 << 24
#: Characters looked at in one go; a longer text is cut with an overlap of four pieces.
STRIDE = 1 << 18
_U = np.uint64
_MUL = [_U(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_ALNUM: list[np.ndarray] = []
_OPEN: dict[str, list[Items]] = {}


def normalize(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points of letters, digits and single spaces, lower-cased, and the place of each."""
    if not _ALNUM:
        _ALNUM.append(np.array([chr(i).isalnum() for i in range(1 << 16)]))
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    word = _ALNUM[0][np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    keep = word.copy()
    keep[1:] |= word[:-1]  # the first of each run of others stands for a space
    place = np.flatnonzero(keep)
    return np.where(word[place], c[place], np.uint32(32)), place


def gram_hashes(c: np.ndarray, q: int = GRAMS[0]) -> np.ndarray:
    """A 64-bit hash of the q code points from each place on, q a power of 2."""
    if len(c) < q:
        return np.zeros(0, _U)
    h = c.astype(_U) + _U(1)
    for step, m in zip((1, 2, 4), _MUL, strict=True):
        if step < q:
            h = (h[:-step] ^ (h[:-step] >> _U(29))) * m + h[step:]
    return h * _MUL[0]


@dataclass
class Items:
    """An index of the q-grams of pieces of items."""

    q: int
    ids: list
    codes: list[np.ndarray]
    budget: np.ndarray
    bound: np.ndarray
    grams: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # where each gram's postings begin, and the end
    item: np.ndarray
    place: np.ndarray
    bits: np.ndarray
    shift: int


def cut_pieces(text: str | None, piece_chars: int = PIECE_CHARS, min_chars: int = MIN_CHARS) -> list[np.ndarray]:
    """The codes that are looked for: the whole item, or half overlapping passages; none of a short item."""
    c = normalize(text or "")[0]
    inside = np.flatnonzero(c != 32)
    c = c[inside[0] : inside[-1] + 1] if len(inside) else c[:0]
    if len(c) < min_chars:
        return []
    if len(c) <= piece_chars:
        return [c]
    starts = [*range(0, len(c) - piece_chars, piece_chars // 2), len(c) - piece_chars]
    return [c[lo : lo + piece_chars] for lo in starts]


def index_pieces(pieces: list[tuple], edit_percent: int = EDIT_PERCENT) -> list[Items]:
    """One index for each q that some piece (id, code) needs."""
    out = []
    gram_of = lambda m: next((q for q in GRAMS if m + 1 - q - q * (m * edit_percent // 100) > 0), GRAMS[-1])
    for q in GRAMS:
        own = [(i, c) for i, c in pieces if gram_of(len(c)) == q]
        if not own:
            continue
        ids, codes = [i for i, _ in own], [c for _, c in own]
        m = np.array([len(c) for c in codes], np.int64)
        budget = np.minimum(m * edit_percent // 100, (m - q) // q)  # lower only where more edits than GRAMS can bear are asked for
        hashes = [gram_hashes(c, q) for c in codes]
        h = np.concatenate(hashes)
        item = np.repeat(np.arange(len(codes)), [len(x) for x in hashes])
        place = np.concatenate([np.arange(len(x)) for x in hashes])
        order = np.argsort(h, kind="stable")
        grams, first = np.unique(h[order], return_index=True)
        shift = 64 - min(26, max(12, int(len(grams)).bit_length() + 6))
        bits = np.zeros(1 << (64 - shift), bool)
        bits[(grams >> _U(shift)).astype(np.int64)] = True
        out.append(Items(q, ids, codes, budget, m + 1 - q - budget * q, grams, np.append(first, len(h)), item[order], place[order], bits, shift))
    return out


def index_items(rows: list[tuple], *, edit_percent: int = EDIT_PERCENT, piece_chars: int = PIECE_CHARS) -> list[Items]:
    return index_pieces([(i, c) for i, text in rows for c in cut_pieces(text, piece_chars)], edit_percent)


def align(item: np.ndarray, text: np.ndarray, low: int, width: int, fixed_start: bool = False) -> tuple[int, int]:
    """Least edits of ``item`` against a part of ``text`` within diagonals low .. low + width - 1,
    and where that part ends; with ``fixed_start`` the part begins at 0."""
    d = np.arange(width)
    inf = len(item) + width + 1
    row = np.abs(d + low) if fixed_start else np.zeros(width, np.int64)
    row = np.where((d + low >= 0) & (d + low <= len(text)), row, inf)
    for i, c in enumerate(item):
        j = i + low + d  # the character of the text that the diagonal step would use
        ok = (j >= 0) & (j < len(text))
        step = row + np.where(ok, text[np.clip(j, 0, len(text) - 1)] != c, inf)
        up = np.append(row[1:], inf) + 1
        best = np.minimum(step, np.where((j + 1 >= 0) & (j + 1 <= len(text)), up, inf))
        row = np.minimum.accumulate(best - d) + d
        row = np.where((j + 1 >= 0) & (j + 1 <= len(text)), row, inf)
    k = int(row.argmin())
    return int(row[k]), len(item) + low + k


def find_items(c: np.ndarray, items: Items) -> list[tuple[int, int, int, int]]:
    """(item, start, end, edits) of the regions of ``c`` within an item's budget."""
    h = gram_hashes(c, items.q)
    at = np.flatnonzero(items.bits[(h >> _U(items.shift)).astype(np.int64)])
    if not len(at):
        return []
    g = np.searchsorted(items.grams, h[at])
    real = items.grams[np.minimum(g, len(items.grams) - 1)] == h[at]
    at, g = at[real], g[real]
    n = items.first[g + 1] - items.first[g]
    which = np.repeat(items.first[g] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    item = items.item[which]
    diagonal = np.repeat(at, n) - items.place[which] + PIECE_CHARS  # not below 0
    half = 2 * items.budget[item] + 1
    band = diagonal // half
    # A q-gram of the item counts once in a half, however often a repetitive text holds it.
    once = np.unique((item << 42) + (band << 10) + items.place[which])
    keys, counts = np.unique(once >> 10, return_counts=True)
    # A band is two neighbouring halves; one that begins in an empty half holds no more than the next.
    both = counts.copy()
    follows = np.flatnonzero(np.diff(keys) == 1)
    both[follows] += counts[follows + 1]
    found: list[tuple[int, int, int, int]] = []
    for key_, n_ in zip(keys.tolist(), both.tolist(), strict=True):
        i, b = key_ >> 32, key_ & ((1 << 32) - 1)
        if n_ < items.bound[i]:
            continue
        code, k = items.codes[i], int(items.budget[i])
        low, width = b * (2 * k + 1) - PIECE_CHARS, 2 * (2 * k + 1)
        lo, hi = max(0, low - k), min(len(c), low + width + len(code) + k)
        region = c[lo:hi]
        spot = region.tobytes().find(code.tobytes())
        while spot > 0 and spot % 4:
            spot = region.tobytes().find(code.tobytes(), spot + 1)
        if spot >= 0:
            hit = (i, lo + spot // 4, lo + spot // 4 + len(code), 0)
        else:
            edits, end = align(code, region, low - lo, width)
            if edits > k:
                continue
            back, length = align(code[::-1], region[:end][::-1], -k, 2 * k + 1, True)
            hit = (i, lo + end - length, lo + end, edits) if back <= k else (i, max(0, lo + end - len(code)), lo + end, edits)
        if found and found[-1][0] == i and hit[1] < found[-1][2] and found[-1][1] < hit[2]:  # the same region by another band
            if hit[3] < found[-1][3]:
                found[-1] = hit
        else:
            found.append(hit)
    return found


def _windows(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes of the texts one after the other, with each code's text and its place there, in cuts of
    about ``STRIDE`` that overlap by four pieces within a text and are apart by a gap between texts."""
    keep = 4 * PIECE_CHARS
    gap = np.full(2 * PIECE_CHARS, np.uint32(0xFFFFFFFF))
    parts: list[tuple] = []
    size = 0
    join = lambda: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    for n, text in enumerate(texts):
        low = text.lower()
        lo = 0
        while lo < len(low):
            hi = min(len(low), lo + STRIDE)
            c, place = normalize(low[lo - 1 : hi] if lo else low[:hi])  # with the character before, which may be a word's
            if lo:
                own = place > 0
                c, place = c[own], place[own] - 1
            parts.append((c, np.full(len(c), n), place + lo))
            size += len(c)
            lo = hi
            if size >= STRIDE and lo < len(low):  # go on in the same text
                whole = join()
                yield whole
                parts = [tuple(x[-keep:] for x in whole)]
                size = len(parts[0][0])
        parts.append((gap, np.full(len(gap), n), np.zeros(len(gap), np.int64)))
        size += len(gap)
        if size >= STRIDE:
            yield join()
            parts, size = [], 0
    if parts:
        yield join()


def find_pieces(texts: list[str], indexes: list[Items]) -> set[tuple[int, object, int, int, int]]:
    """(text, item id, start, end, edits) of the pieces found, with places in the lower-cased text."""
    found = []
    for c, owner, place in _windows(texts) if indexes else ():
        for k, items in enumerate(indexes):
            for i, s, e, edits in find_items(c, items):
                own = np.flatnonzero(c[s:e] != 0xFFFFFFFF) + s
                if len(own):
                    found.append((int(owner[own[0]]), k, i, int(place[own[0]]), int(place[own[-1]]) + 1, edits))
    best: list[tuple] = []
    for hit in sorted(found):
        if best and hit[:3] == best[-1][:3] and hit[3] < best[-1][4]:  # the same region in the overlap of two cuts
            best[-1] = min(best[-1], hit, key=lambda x: x[5])
        else:
            best.append(hit)
    return {(n, indexes[k].ids[i], s, e, edits) for n, k, i, s, e, edits in best}


def merge_regions(found: set[tuple]) -> list[tuple[int, object, int, int, int]]:
    """What is found of one item in one text side by side is one region, with the most edits of a piece in it."""
    out: list[list] = []
    for n, i, s, e, edits in sorted(found, key=lambda x: (x[0], str(x[1]), x[2], x[3])):
        if out and out[-1][:2] == [n, i] and s <= out[-1][3]:
            out[-1][3:] = [max(out[-1][3], e), max(out[-1][4], edits)] if e > out[-1][3] else [out[-1][3], out[-1][4]]
        else:
            out.append([n, i, s, e, edits])
    return [tuple(x) for x in out]


def find_in_texts(texts: list[str], indexes: list[Items]) -> list[tuple[int, object, int, int, int]]:
    """(text, item id, start, end, edits) with places in the lower-cased text."""
    return merge_regions(find_pieces(texts, indexes))


class Benchmark:
    """The pieces of all items, each once, in blocks that tasks open one at a time."""

    def __init__(self, bench: DataFrame, item_col: str, text_col: str, edit_percent: int, block_chars: int):
        spark = bench.sparkSession
        self.edit_percent, self.key = edit_percent, uuid.uuid4().hex
        kind = bench.schema[item_col].dataType
        self.item_type = to_arrow_type(kind)
        item_type = self.item_type

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, text in enumerate(batch.column(1)):
                    codes = [c.tobytes() for c in cut_pieces(text.as_py())]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[n].as_py()] * len(codes), item_type), pa.array(codes, pa.binary())], names=["id", "code"])

        pieces = bench.select(item_col, text_col).where(F.col(text_col).isNotNull()).mapInArrow(run, f"id {kind.simpleString()}, code binary")
        self.blocks, self.pieces = 1, None
        size = bench.agg(F.sum(F.length(text_col)).alias("n")).first()["n"] or 0
        if size <= block_chars:
            rows = [(r["id"], np.frombuffer(bytes(r["code"]), np.uint32)) for r in pieces.distinct().collect()]  # of at most ``block_chars`` characters, each in two pieces at most
            self.pieces = spark.sparkContext.broadcast(rows)
            return
        self.blocks = -(-int(size) // block_chars)
        self.folder = f"items-{self.key}"
        path = f"{shared_dir(spark).rstrip('/')}/keyloom/{self.folder}"
        block = F.pmod(F.xxhash64("id", "code"), F.lit(self.blocks)).cast("int")
        pieces.distinct().withColumn("block", block).repartition(self.blocks, "block").write.partitionBy("block").parquet(path)
        forget_at_end(spark, path)
        spark.sparkContext.addFile(path, recursive=True)

    def indexes(self, block: int) -> list[Items]:
        """In a task: the index of one block; that of a single block is made once in a worker."""
        if self.pieces is not None:
            if self.key not in _OPEN:
                _OPEN.clear()
                _OPEN[self.key] = index_pieces(self.pieces.value, self.edit_percent)
            return _OPEN[self.key]
        at = os.path.join(SparkFiles.get(self.folder), f"block={block}")
        if not os.path.isdir(at):  # no piece fell into it
            return []
        table = pa.concat_tables([pq.ParquetFile(os.path.join(at, f)).read() for f in sorted(os.listdir(at)) if f.endswith(".parquet")])
        return index_pieces([(i, np.frombuffer(c, np.uint32)) for i, c in zip(table["id"].to_pylist(), table["code"].to_pylist(), strict=True)], self.edit_percent)

    def find(self, texts: list[str]) -> list[tuple[int, object, int, int, int]]:
        found: set = set()
        for block in range(self.blocks):
            found |= find_pieces(texts, self.indexes(block))
        return merge_regions(found)

    def group(self, column: pa.Array) -> Iterator[list[str]]:
        """Few texts at a time for one block, many to open a file for."""
        return text_groups(column, 500, 1 << 21) if self.blocks == 1 else text_groups(column, 1 << 20, GROUP_CHARS)


def find_leaks(docs: DataFrame, bench: DataFrame, *, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", edit_percent: int = EDIT_PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, start, end, edits): every region of ``docs`` that holds an item or a passage of one."""
    kinds = docs.schema[id_col].dataType, bench.schema[item_col].dataType
    schema = f"`{id_col}` {kinds[0].simpleString()}, `{item_col}` {kinds[1].simpleString()}, start long, end long, edits long"
    items = Benchmark(bench, item_col, text_col, edit_percent, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in items.group(batch.column(1)):
                hits = items.find(texts)
                own = batch.column(0).take(pa.array([lo + x[0] for x in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([own, pa.array([x[1] for x in hits], items.item_type), *(pa.array([x[k] for x in hits], pa.int64()) for k in (2, 3, 4))], names=[id_col, item_col, "start", "end", "edits"])
                lo += len(texts)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def drop_leaks(docs: DataFrame, bench: DataFrame, *, item_col: str = "item_id", text_col: str = "text", edit_percent: int = EDIT_PERCENT, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no item, whole; nothing is shuffled."""
    at = docs.columns.index(text_col)
    items = Benchmark(bench, item_col, text_col, edit_percent, block_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            for texts in items.group(batch.column(at)):
                clean = np.ones(len(texts), bool)
                clean[[x[0] for x in items.find(texts)]] = False
                yield batch.slice(lo, len(texts)).filter(pa.array(clean))
                lo += len(texts)

    return docs.mapInArrow(run, docs.schema)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_decontaminate": op2_decontaminate}
