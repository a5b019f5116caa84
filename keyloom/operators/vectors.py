"""Vector sets: rows (key, elem, vec), compared by cosine."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.bind import bind


def vadd(log: DataFrame) -> DataFrame:
    """The first vector of each element stays; dimensions are those of the key's first write."""
    first = log.groupBy("key", "elem").agg(F.min_by("vec", "seq").alias("vec"), F.min("seq").alias("seq"))
    dims = log.groupBy("key").agg(F.min_by(F.size("vec"), "seq").alias("_dim"))
    return first.join(dims, "key").where(F.size("vec") == F.col("_dim")).drop("_dim", "seq")


def unit_vector(vec: Column) -> Column:
    """Scaled by its largest entry first, so that squares stay finite; a zero vector stays."""
    length = lambda s: F.sqrt(F.aggregate(s, F.lit(0.0), lambda t, x: t + x * x))
    by = lambda v, n: F.transform(v, lambda x: x / n)
    scaled = lambda v, top: bind(by(v, top), lambda s: bind(length(s), lambda n: by(s, n)))
    top = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x)))
    return bind(vec.cast("array<double>"), lambda v: bind(top(v), lambda t: F.when(t > 0, scaled(v, t)).otherwise(v)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vemb(v: DataFrame) -> DataFrame:
    return v.select("key", "elem", unit_vector(F.col("vec")).alias("vec"))


def vsim(v: DataFrame, query: list[float], k: int = 10, *, by_key: bool = True) -> DataFrame:
    """The k most similar elements, of each key or of all; ties go to the smaller element."""
    top = max((abs(x) for x in query), default=0.0) or 1.0
    norm = math.sqrt(sum((x / top) ** 2 for x in query)) or 1.0
    q = F.array(*[F.lit(float(x) / top / norm) for x in query])
    rows = v.select("key", "elem", dot(unit_vector(F.col("vec")), q).alias("score"))
    if not by_key:
        return rows.orderBy(F.col("score").desc(), "elem").limit(k)
    w = Window.partitionBy("key").orderBy(F.col("score").desc(), "elem")
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def vsim_elem(v: DataFrame, elem, k: int = 10) -> DataFrame:
    """Similar to an element of the set, over all keys; an unknown one finds nothing."""
    row = v.where(F.col("elem") == F.lit(elem)).select("vec").first()
    return vsim(v, list(row["vec"]), k, by_key=False) if row else v.select("key", "elem", F.lit(0.0).alias("score")).limit(0)


#: Rows and queries that meet in one task: a few hundred MB of vectors at the most.
BLOCK_ROWS, BLOCK_QUERIES, STRIDE = 100_000, 8_192, 1_024


def _unit_rows(vecs: pa.Array) -> np.ndarray:
    x = np.array(vecs.to_pylist(), np.float64).reshape(len(vecs), -1)
    top = np.abs(x).max(1, keepdims=True, initial=0)
    x = x / np.where(top > 0, top, 1)
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def vlinks(v: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, elem, score, rank): the k nearest other elements of each query (elem, vec).

    Queries and rows are dealt to blocks whose numbers follow from their counts, and every pair of
    blocks is one task: a product of two matrices, ``STRIDE`` rows at a time, of which each query's
    k best go on. A row travels once for every ``BLOCK_QUERIES`` queries, a query once for every
    ``BLOCK_ROWS`` rows. Vectors have one length; ties go to the smaller element.
    """
    n_rows, n_queries = -(-v.count() // BLOCK_ROWS), -(-queries.count() // BLOCK_QUERIES)
    deal = lambda n: F.pmod(F.xxhash64("elem"), F.lit(max(1, n)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))).cast("array<long>"))
    rows = v.select("elem", "vec", deal(n_rows).alias("_r"), every(n_queries).alias("_q"))
    asked = queries.select("elem", "vec", every(n_rows).alias("_r"), deal(n_queries).alias("_q"))

    def best(own: pa.Table, ask: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if own.num_rows and ask.num_rows:
            elems, names = own["elem"].to_pylist(), ask["elem"].to_pylist()
            order = sorted(range(len(elems)), key=elems.__getitem__)
            held = _unit_rows(own["vec"].combine_chunks())[order]
            elems = [elems[i] for i in order]
            asks = _unit_rows(ask["vec"].combine_chunks())
            for lo in range(0, len(names), STRIDE):
                score = asks[lo : lo + STRIDE] @ held.T
                for i, s in enumerate(score):
                    # One more than k, as the query itself may be among them; ties in order of elements.
                    edge = np.partition(s, len(s) - k - 1)[len(s) - k - 1] if len(s) > k + 1 else -np.inf
                    near = np.flatnonzero(s >= edge)
                    near = near[np.argsort(-s[near], kind="stable")]
                    out += [(names[lo + i], elems[j], float(s[j])) for j in near if elems[j] != names[lo + i]][:k]
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        return pa.table([pa.array(cols[0], ask.schema.field("elem").type), pa.array(cols[1], own.schema.field("elem").type), pa.array(cols[2], pa.float64())], ["query", "elem", "score"])

    kinds = queries.schema["elem"].dataType.simpleString(), v.schema["elem"].dataType.simpleString()
    met = rows.groupBy("_q", "_r").cogroup(asked.groupBy("_q", "_r")).applyInArrow(best, f"query {kinds[0]}, elem {kinds[1]}, score double")
    w = Window.partitionBy("query").orderBy(F.col("score").desc(), "elem")
    return met.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def vcard(v: DataFrame) -> DataFrame:
    return v.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).cast("long").alias("dims"))


def vrem(v: DataFrame, gone: DataFrame) -> DataFrame:
    return v.join(gone.select("key", "elem"), ["key", "elem"], "left_anti")


def vgetattr(v: DataFrame, attrs: DataFrame) -> DataFrame:
    """Attributes (key, elem, attr) of elements; an empty one is none."""
    return v.select("key", "elem").join(attrs.where("attr <> ''"), ["key", "elem"], "left")


def vsetattr(attrs: DataFrame, log: DataFrame, v: DataFrame) -> DataFrame:
    """The attributes after a log (key, elem, attr, seq): the last write of each element that ``v``
    holds; an empty one clears."""
    last = log.join(v.select("key", "elem"), ["key", "elem"], "left_semi").groupBy("key", "elem").agg(F.max_by("attr", "seq").alias("attr"))
    kept = attrs.select("key", "elem", "attr").join(last.select("key", "elem"), ["key", "elem"], "left_anti")
    return kept.union(last.where("attr <> ''"))


def vismember(v: DataFrame, request: DataFrame) -> DataFrame:
    """(key, elem, is_member) of each request."""
    held = v.select("key", "elem", F.lit(1).alias("_in"))
    return request.join(held, ["key", "elem"], "left").select("key", "elem", F.coalesce("_in", F.lit(0)).alias("is_member"))


def vinfo(v: DataFrame) -> DataFrame:
    """(key, quant_type, vector_dim, size) of each set."""
    size = v.groupBy("key").agg(F.max(F.size("vec")).cast("long").alias("vector_dim"), F.count(F.lit(1)).alias("size"))
    return size.select("key", F.lit("f32").alias("quant_type"), "vector_dim", "size")


def vrandmember(v: DataFrame, n: int, seed: int = 0) -> DataFrame:
    pick = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "elem"), "elem"))
    return v.withColumn("_n", pick).where(F.col("_n") <= n).drop("_n")
