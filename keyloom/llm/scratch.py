"""Cut points: tables written to the shared folder named by ``spark.checkpoint.dir``.

A written table cuts the lineage: a lost executor costs a reread, not a recomputation, and a
costly step (tokenizing, hashing) runs once however many later steps read it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from keyloom.sources.shared import shared_dir

__all__ = ["cut", "forget", "forget_at_end", "shared_dir"]


def _store(spark: SparkSession, path: str) -> tuple:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def forget_at_end(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver ends."""
    store, jpath = _store(spark, path)
    store.deleteOnExit(jpath)


def forget(spark: SparkSession, path: str) -> None:
    """The folder goes now."""
    store, jpath = _store(spark, path)
    store.delete(jpath, True)


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back; removed when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/keyloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
