"""Registered queries answer for every row of their input, whatever its ids."""

import pytest
from keyloom.catalogue import QUERIES
from pyspark.sql import functions as F

#: Ids far above any prefix that a query once took.
FIRST = 10_000


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    i = F.col("id")
    orders = spark.range(FIRST, FIRST + 40).select(i.alias("o_orderkey"), (i % 8 + FIRST).alias("o_custkey"), F.concat(F.lit("s"), i).alias("o_orderstatus"), F.lit("1-URGENT").alias("o_orderpriority"))
    orders.write.parquet(f"{d}/orders.parquet")
    segment = F.when(i % 4 < 2, "BUILDING").otherwise("MACHINERY")
    spark.range(FIRST, FIRST + 8).select(i.alias("c_custkey"), segment.alias("c_mktsegment")).write.parquet(f"{d}/customer.parquet")
    return d


def test_hgetall_returns_every_hash(spark, tables):
    got = rows(QUERIES["hgetall_all"](spark, tables))
    assert got == sorted([(k, f, v) for k in range(FIRST, FIRST + 40) for f, v in (("custkey", str(k % 8 + FIRST)), ("status", f"s{k}"), ("priority", "1-URGENT"))], key=repr)


def test_set_xx_reads_the_whole_log(spark, tables):
    last = [(k, f"s{k + 32}") for k in range(FIRST, FIRST + 8) if k % 4 < 2]
    assert rows(QUERIES["set_xx_all"](spark, tables)) == last
    assert rows(QUERIES["msetnx_refused_all"](spark, tables)) == last


def test_hmget_asks_for_every_order(spark, tables):
    got = rows(QUERIES["hmget_all"](spark, tables))
    want = [(k, key, field, f"s{k}" if (key, field) == (k, "status") else None) for k in range(FIRST, FIRST + 40) for key in (k, -1 - k) for field in ("status", "missing")]
    assert got == sorted(want, key=repr)
