"""From raw documents to packed sequences, stage by stage.

1. language ID: documents without a letter, or whose language is below ``MIN_LANG_SCORE``, go;
2. line dedup: lines that several documents share stay in the first only, texts that this empties go;
3. MinHash near-dedup: five-word shingles, similarity 0.8; the smallest doc_id of a group stays;
4. benchmark decontamination: documents that hold a benchmark item go;
5. best-fit packing of the rest into sequences of 2048 tokens.

Each stage reads its predecessor's table whole; all but the last return the columns of documents.
A repeated doc_id: language ID and decontamination judge each of its rows by itself, line dedup takes
its rows for one document, near-dedup keeps one row of it, the least by text, lang, source and
n_chars, so packing sees an id once. A null text goes with the first stage; rows without an id stay.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm.decontaminate import drop_leaks
from keyloom.llm.lang_id import UND, identify, learn_languages
from keyloom.llm.line_dedup import dedup_lines
from keyloom.llm.near_dedup import near_duplicates
from keyloom.llm.packing import pack_documents
from keyloom.llm.scratch import cut, forget, forget_at_end, shared_dir
from keyloom.sources import read_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Four languages guessed blindly would score 0.25; a few words of prose score far more.
MIN_LANG_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    seen = identify(docs, learn_languages(docs))
    return seen.where((F.col("lang_pred") != UND) & (F.col("score") >= MIN_LANG_SCORE)).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = dedup_lines(docs).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A repeated row is a copy too: the least row of a doc_id stays. Rows without an id are left alone."""
    facts = near_duplicates(docs).where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    facts = cut(facts.where("NOT kept OR n > 1"), "facts")
    once = docs.join(facts.select("doc_id"), "doc_id", "left_anti").select(*COLUMNS)
    again = docs.join(facts.where("kept").select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("row"))
    return once.union(again.select("doc_id", "row.*").select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_leaks(docs.select(*COLUMNS), read_table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("packing", packing),
]

#: A recurrent network and a tokenizer are not SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again by the next, then removed."""
    docs, before = read_table(spark, sf_dir, "documents"), None
    top = f"{shared_dir(spark).rstrip('/')}/keyloom/pipeline-{uuid.uuid4().hex}"
    forget_at_end(spark, top)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{name}")
        docs = spark.read.parquet(f"{top}/{name}")
        if before:
            forget(spark, before)
        before = f"{top}/{name}"
    packed = STAGES[-1][1](spark, docs, sf_dir)  # has written its pieces, which is all that it still reads
    forget(spark, top)
    return packed
