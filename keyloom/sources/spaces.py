"""Key spaces in long format, derived from the relational tables.

Each function returns one row for each element: (key, member, score) for sorted sets, (key, member)
for sets, (key, field, value) for hashes, (key, pos, value) for lists, (key, bit) for bitmaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from keyloom.sources.tables import read_table


def accounts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("member"), F.col("c_acctbal").alias("score"))


def supplier_accounts(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "supplier").select(F.col("s_nationkey").alias("key"), F.col("s_name").alias("member"), F.col("s_acctbal").alias("score"))


def part_quantities(spark: SparkSession, d: str) -> DataFrame:
    lines = read_table(spark, d, "lineitem").select("l_returnflag", "l_partkey", "l_quantity")
    return lines.groupBy(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))


def customers_by_priority(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member")).distinct()


def brand_sizes(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "part").select(F.col("p_brand").alias("key"), F.col("p_size").alias("member")).distinct()


def order_hashes(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").cast("string").alias("custkey"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return o.unpivot("key", ["custkey", "status", "priority"], "field", "value")


def event_props(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select(F.col("event_id").alias("key"), "props")
    return e.select("key", F.explode(F.from_json("props", "map<string,string>")).alias("field", "value"))


def click_lists(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("key"), pos.cast("long").alias("pos"), F.col("event_type").alias("value"))


def user_bits(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit")).distinct()


def customer_places(spark: SparkSession, d: str) -> DataFrame:
    c = read_table(spark, d, "customer").select("c_nationkey", "c_custkey")
    lon, lat = (F.col("c_custkey") * 137.508) % 360 - 180, (F.col("c_custkey") * 61.803) % 180 - 90
    return c.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("member"), lon.alias("lon"), lat.alias("lat"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("label").alias("key"), F.col("vec_id").alias("elem"), F.col("embedding").alias("vec"))


def price_index(spark: SparkSession, d: str) -> DataFrame:
    o = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return o.select(F.format_string("%010d", "o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))


def expiring_events(spark: SparkSession, d: str) -> DataFrame:
    """expire_at in ms: the event's time plus value minutes."""
    e = read_table(spark, d, "events").select("event_id", "ts", "value")
    at = F.unix_millis(F.col("ts").cast("timestamp")) + F.round(F.col("value") * 60000).cast("long")
    return e.select(F.col("event_id").alias("key"), at.alias("expire_at"))


def order_log(spark: SparkSession, d: str) -> DataFrame:
    """A command log of string writes: key the customer, value the status, in order of orders."""
    o = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"))
