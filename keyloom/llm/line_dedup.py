"""Line dedup: lines that several documents share stay only in the first of them.

Every text is split at \\n and each line's key is hashed to 128 bits. One aggregation over the
hashes, pre-aggregated before its shuffle, counts the documents of each key; the keys over the
threshold, written to the shared folder, are joined back to (document, position, hash) rows, never
to texts, and each document is put together again by position. Keys that hold a large part of all
lines are dealt to many tasks in that join. All expressions are JVM-side.

A document is a (doc_id, text) pair: equal rows get equal results, and one row comes out for
every row in. A null text is one empty line. A null doc_id counts as one document of its own,
after every other. Only ``id_col`` and ``text_col`` are read; ``dedup_lines`` carries any further
columns along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.scratch import cut
from keyloom.llm.skew import hot_keys, salted_join
from keyloom.llm.text import ascii_lower, strip_blanks
from keyloom.sources import read_table

MIN_CHARS = 10
MIN_DOCS = 2


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _shared(rows: DataFrame, min_docs: int) -> DataFrame:
    """The hashes that at least ``min_docs`` documents hold, with the smallest such doc_id and the number of lines."""
    ids = [F.min("_id").alias("_first"), F.max("_id").alias("_last"), F.max(F.col("_id").isNull()).alias("_null")]
    if min_docs == 2:  # two documents at least: the ends differ, no distinct count is needed
        held = rows.groupBy("_h1", "_h2").agg(*ids, F.count(F.lit(1)).alias("n"))
        many = (F.col("_first") != F.col("_last")) | (F.col("_null") & F.col("_first").isNotNull())
    else:
        docs = rows.groupBy("_h1", "_h2", "_id").agg(F.count(F.lit(1)).alias("_lines"))
        held = docs.groupBy("_h1", "_h2").agg(*ids, F.count(F.lit(1)).alias("_docs"), F.sum("_lines").alias("n"))
        many = F.col("_docs") >= min_docs
    return held.where(F.coalesce(many, F.lit(False))).select("_h1", "_h2", "_first", "n")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with its text rewritten, and n_lines, n_dropped (long) added.

    Keys of ``min_chars`` code points or more that ``min_docs`` documents or more hold lose all
    their lines except those in the smallest doc_id. Names that start with ``_ld_`` are taken.
    A very long text is one row all along; its lines are rows of their own only as hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    keyed = own.select("_id", F.xxhash64("_text").alias("_t1"), F.xxhash64(F.lit(7), "_text").alias("_t2"), F.posexplode(_lines(F.col("_text"))).alias("_pos", "_line"))
    keyed = keyed.select("_id", "_t1", "_t2", "_pos", ascii_lower(strip_blanks(F.col("_line"))).alias("_key")).where(F.length("_key") >= min_chars)
    hashed = keyed.select("_id", "_t1", "_t2", "_pos", F.xxhash64("_key").alias("_h1"), F.xxhash64(F.lit(7), "_key").alias("_h2"))
    shared, keys = cut(_shared(hashed.select("_id", "_h1", "_h2"), min_docs), "lines"), ["_h1", "_h2"]
    gone = salted_join(hashed, shared.drop("n"), keys, hot_keys(shared, keys), by=["_id", "_pos"]).where(~F.col("_id").eqNullSafe(F.col("_first")))
    # A set, as equal rows send their positions twice.
    gone = gone.groupBy(F.col("_id").alias("_ld_id"), F.col("_t1").alias("_ld_t1"), F.col("_t2").alias("_ld_t2")).agg(F.collect_set("_pos").alias("_ld_gone"))

    rows = docs.withColumns({"_ld_a": F.xxhash64(text), "_ld_b": F.xxhash64(F.lit(7), text)})
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col("_ld_id")) & (F.col("_ld_a") == F.col("_ld_t1")) & (F.col("_ld_b") == F.col("_ld_t2")), "left")
    lines = _lines(F.col(text_col))
    n_dropped = F.coalesce(F.size("_ld_gone"), F.lit(0))
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_ld_gone")
    kept = F.when(F.col("_ld_gone").isNull(), text).otherwise(F.array_join(F.transform(places, lambda p: F.element_at(F.col("_ld_lines"), p + 1)), "\n"))
    rows = rows.withColumns({"_ld_lines": lines, "n_lines": F.size(lines).cast("long"), "n_dropped": n_dropped.cast("long")})
    return rows.withColumn(text_col, kept).drop("_ld_a", "_ld_b", "_ld_id", "_ld_t1", "_ld_t2", "_ld_gone", "_ld_lines")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, pos, parts[pos] AS line,
         translate(trim(parts[pos], chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), shared AS (
  SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT l.doc_id, l.pos, l.line, (s.key IS NOT NULL AND l.doc_id <> s.owner) AS gone
  FROM lines l LEFT JOIN shared s ON l.key = s.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": ORACLE}
