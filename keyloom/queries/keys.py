"""String, counter, keyspace and hash queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.slots import key_slot
from keyloom.operators import hashes as H
from keyloom.operators import keyspace as K
from keyloom.operators import strings as T
from keyloom.queries import Book
from keyloom.sources.spaces import accounts, click_lists, customers_by_priority, event_props, expiring_events, order_hashes, order_log
from keyloom.sources.tables import read_table

book = Book()

#: 2024-01-15 00:00 UTC in ms: the clock of all expiry queries.
NOW = 1705276800000
LOG = "log AS (SELECT o_custkey AS key, o_orderkey AS seq, o_orderstatus AS value FROM orders)"
EXP = "ex AS (SELECT event_id AS key, epoch_us(ts) // 1000 + round(value * 60000)::BIGINT AS expire_at FROM events)"
SEGMENT = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'"
HASH = "h AS (SELECT o_orderkey AS key, field, value FROM (SELECT o_orderkey, o_custkey::VARCHAR AS custkey, o_orderstatus AS status, o_orderpriority AS priority FROM orders) UNPIVOT (value FOR field IN (custkey, status, priority)))"


def _orders(spark, d):
    return read_table(spark, d, "orders")


def _segment(spark, d):
    """The keys that exist before a write: the customers of one segment, a part that grows with the input."""
    return read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))


@book.add(f"WITH {LOG} SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key")
def set_lww(spark, d):
    return T.set_last(order_log(spark, d))


@book.add(f"WITH {LOG} SELECT key, arg_min(value, seq) AS value FROM log GROUP BY key")
def setnx_first(spark, d):
    return T.setnx(order_log(spark, d))


@book.add(f"WITH {LOG} SELECT key, arg_max(value, seq) AS value FROM log WHERE key IN ({SEGMENT}) GROUP BY key", also="set_xx_all")
def set_xx(spark, d):
    return T.setxx(order_log(spark, d), _segment(spark, d))


@book.add("SELECT c_custkey + 1 AS pos, c_custkey * 3 AS key, o.value FROM customer LEFT JOIN (SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1) o ON o.key = c_custkey * 3")
def mget(spark, d):
    request = read_table(spark, d, "customer").select((F.col("c_custkey") + 1).alias("pos"), (F.col("c_custkey") * 3).alias("key"))
    return T.mget(T.set_last(order_log(spark, d)), request)


@book.add(f"WITH {LOG} SELECT *, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM log")
def getset_lag(spark, d):
    return T.getset(order_log(spark, d))


@book.add("SELECT o_custkey AS key, o_orderkey AS seq, (o_totalprice * 100)::BIGINT % 1000 AS delta, sum((o_totalprice * 100)::BIGINT % 1000) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::BIGINT AS after FROM orders")
def incr_running(spark, d):
    return T.incr_running(_deltas(spark, d))


@book.add("SELECT o_custkey AS key, sum((o_totalprice * 100)::BIGINT % 1000)::BIGINT AS value FROM orders GROUP BY 1")
def incrby(spark, d):
    return T.incr_net(_deltas(spark, d))


def _deltas(spark, d):
    return _orders(spark, d).select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), (F.round(F.col("o_totalprice") * 100).cast("long") % 1000).alias("delta"))


@book.add("SELECT event_type AS key, event_id AS seq, round(value * 4) / 4 AS delta, sum(round(value * 4) / 4) OVER (PARTITION BY event_type ORDER BY event_id) AS after FROM events")
def incrbyfloat_running(spark, d):
    e = read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), (F.round(F.col("value") * 4) / 4).alias("delta"))
    return T.incr_running(e)


@book.add("SELECT o_custkey AS key, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS value FROM orders GROUP BY 1")
def append(spark, d):
    return T.append(order_log(spark, d))


@book.add("SELECT p_partkey AS key, strlen(p_name)::INT AS n, p_name[2:4] AS middle, p_name[-3:] AS tail FROM part")
def strlen_getrange(spark, d):
    v = F.col("p_name")
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("key"), T.strlen(v).alias("n"), T.getrange(v, 1, 3).cast("string").alias("middle"), T.getrange(v, -3, -1).cast("string").alias("tail"))


@book.add("SELECT p_partkey AS key, p_name[1:3] || 'XYZ' || p_name[7:] AS value FROM part")
def setrange(spark, d):
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("key"), T.setrange(F.col("p_name"), 3, "XYZ").cast("string").alias("value"))


@book.add(f"WITH {LOG} SELECT key, arg_max(value, seq) AS value FROM log WHERE key IN ({SEGMENT}) GROUP BY key", also="msetnx_refused_all")
def msetnx_refused(spark, d):
    kv = T.set_last(order_log(spark, d))
    return T.msetnx(kv.join(_segment(spark, d), "key", "left_semi"), kv)


@book.add(f"WITH {EXP} SELECT key, CASE WHEN expire_at IS NULL OR expire_at <= {NOW} THEN -2 ELSE expire_at - {NOW} END AS pttl FROM ex")
def ttl_remaining(spark, d):
    e = expiring_events(spark, d)
    return K.pttl(e, e.select("key"), NOW)


@book.add(f"WITH {EXP} SELECT key, CASE WHEN expire_at <= {NOW} THEN -2 ELSE (expire_at - {NOW} + 999) // 1000 END AS ttl FROM ex")
def ttl_seconds(spark, d):
    e = expiring_events(spark, d)
    return K.ttl(e, e.select("key"), NOW)


@book.add(f"WITH {EXP} SELECT * FROM ex WHERE expire_at > {NOW}")
def expire_filter(spark, d):
    return K.live(expiring_events(spark, d), NOW)


@book.add(f"WITH {EXP}, alive AS (SELECT * FROM ex WHERE expire_at > {NOW}) SELECT key, CASE WHEN {NOW} + 3600000 > expire_at THEN {NOW} + 3600000 ELSE expire_at END AS expire_at FROM alive")
def expire_gt(spark, d):
    return K.expire(expiring_events(spark, d), F.lit(NOW + 3600000), NOW, "GT")


@book.add(f"WITH {EXP} SELECT key, CASE WHEN expire_at > {NOW} + 86400000 THEN NULL ELSE expire_at END AS expire_at FROM ex WHERE expire_at > {NOW}")
def persist(spark, d):
    """Of those asked for, keys that expire within a day keep their deadline and expired keys stay gone."""
    e = expiring_events(spark, d)
    asked = e.where((F.col("expire_at") > NOW + 86400000) | (F.col("expire_at") <= NOW))
    return K.persist(e, asked.select("key"), NOW).select("key", "expire_at")


@book.add(f"WITH {EXP} SELECT count(*) FILTER (WHERE expire_at <= {NOW}) AS expired, count(*) AS scanned FROM ex")
def expdelscan(spark, d):
    return K.expdelscan(expiring_events(spark, d), NOW)


@book.add(f"WITH {EXP} SELECT key, expire_at // 1000 AS expiretime FROM ex")
def expiretime(spark, d):
    return expiring_events(spark, d).select("key", K.expiretime(F.col("expire_at")).alias("expiretime"))


@book.add("SELECT DISTINCT c_name AS key FROM customer WHERE c_name GLOB 'Customer#0000*[13579]?'")
def keys_glob(spark, d):
    return K.keys_matching(read_table(spark, d, "customer").select(F.col("c_name").alias("key")), "Customer#0000*[13579]?")


@book.add("SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def exists_multi(spark, d):
    have = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return K.exists(have, _orders(spark, d).select(F.col("o_custkey").alias("key")))


def _tables(spark, d):
    named = lambda df, kind: df.select(F.concat(F.lit(f"{kind}:"), F.col("key")).alias("key"))
    return {"zset": named(accounts(spark, d), "acct"), "set": named(customers_by_priority(spark, d), "cust"), "list": named(click_lists(spark, d), "clicks"), "string": named(order_log(spark, d), "str")}


_TYPES = "SELECT 'acct:' || c_nationkey AS key, 'zset' AS type FROM customer UNION SELECT 'cust:' || o_orderpriority, 'set' FROM orders UNION SELECT 'clicks:' || user_id, 'list' FROM events UNION SELECT 'str:' || o_custkey, 'string' FROM orders"


@book.add(_TYPES)
def type_of(spark, d):
    return K.typed(_tables(spark, d))


@book.add(f"SELECT count(*) AS n FROM ({_TYPES})")
def dbsize(spark, d):
    return K.dbsize(_tables(spark, d))


@book.add("SELECT CASE WHEN key = '1-URGENT' THEN '5-LOW' ELSE key END AS key, member FROM (SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders) WHERE key <> '5-LOW'")
def rename(spark, d):
    return K.rename(customers_by_priority(spark, d), "1-URGENT", "5-LOW")


@book.add("SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def del_keys(spark, d):
    gone = spark.createDataFrame([("1-URGENT",), ("2-HIGH",), ("none",)], "key string")
    return K.delete(customers_by_priority(spark, d), gone)


@book.add(f"WITH {HASH} SELECT key, field, value FROM h", also="hgetall_all")
def hgetall(spark, d):
    maps = H.hgetall(order_hashes(spark, d))
    return maps.select("key", F.explode("fields").alias("field", "value"))


@book.add("SELECT o_orderkey AS pos, k AS key, f AS field, CASE f WHEN 'status' THEN status END AS value FROM (SELECT o_orderkey, unnest([o_orderkey, -1 - o_orderkey]) AS k FROM orders) r CROSS JOIN (VALUES ('status'), ('missing')) t(f) LEFT JOIN (SELECT o_orderkey AS ok, o_orderstatus AS status FROM orders) o ON ok = k", also="hmget_all")
def hmget(spark, d):
    keys = _orders(spark, d).select(F.col("o_orderkey").alias("pos"), F.explode(F.array(F.col("o_orderkey"), -1 - F.col("o_orderkey"))).alias("key"))
    request = keys.select("pos", "key", F.explode(F.array(F.lit("status"), F.lit("missing"))).alias("field"))
    return H.hmget(order_hashes(spark, d), request)


@book.add("SELECT user_id AS key, event_type AS field, sum((value * 100)::BIGINT)::BIGINT AS value FROM events GROUP BY 1, 2")
def hincrby(spark, d):
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.round(F.col("value") * 100).cast("long").alias("delta"))
    return H.hincrby(e)


@book.add("SELECT user_id AS key, event_type AS field, arg_max(props, event_id) AS value FROM events GROUP BY 1, 2")
def hset_lww(spark, d):
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return H.hset(e)


@book.add("SELECT event_id AS key, 'k' AS field, json_extract_string(props, '$.k') AS value FROM events")
def hash_props(spark, d):
    return event_props(spark, d)


@book.add(f"WITH {HASH} SELECT key, count(*) AS n FROM h GROUP BY key")
def hlen(spark, d):
    return H.hlen(order_hashes(spark, d))


@book.add(f"WITH {HASH} SELECT key, field FROM h WHERE field = 'status' AND key IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def hexists(spark, d):
    request = _orders(spark, d).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("key"), F.explode(F.array(F.lit("status"), F.lit("nope"))).alias("field"))
    return H.hexists(order_hashes(spark, d), request)


@book.add(f"WITH {HASH} SELECT key, field, value FROM h WHERE field <> 'status'")
def hdel(spark, d):
    h = order_hashes(spark, d)
    return H.hdel(h, _orders(spark, d).select(F.col("o_orderkey").alias("key"), F.lit("status").alias("field")))


def _volatile(spark, d):
    e = expiring_events(spark, d)
    at = F.when(F.col("key") % 3 != 0, F.col("expire_at"))
    return e.select(F.col("key"), F.lit("k").alias("field"), F.lit("v").alias("value"), at.alias("expire_at"))


VOL = f"{EXP}, vol AS (SELECT key, 'k' AS field, CASE WHEN key % 3 <> 0 THEN expire_at END AS expire_at FROM ex)"


@book.add(f"WITH {VOL} SELECT key, field, CASE WHEN expire_at <= {NOW} THEN -2 WHEN expire_at IS NULL OR {NOW} + 60000 < expire_at THEN 1 ELSE 0 END AS code, CASE WHEN expire_at <= {NOW} THEN NULL WHEN expire_at IS NULL OR {NOW} + 60000 < expire_at THEN {NOW} + 60000 ELSE expire_at END AS expire_at FROM vol")
def hexpire_lt(spark, d):
    return H.hexpire(_volatile(spark, d), F.lit(NOW + 60000), NOW, "LT")


@book.add(f"WITH {VOL} SELECT key, field, CASE WHEN expire_at IS NULL THEN -1 WHEN expire_at <= {NOW} THEN -2 ELSE (expire_at - {NOW}) // 1000 END AS ttl FROM vol")
def httl(spark, d):
    v = _volatile(spark, d)
    return H.httl(v, v.select("key", "field"), NOW)


@book.add(f"WITH {HASH} SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY field) AS rn FROM h) WHERE rn <= 2 AND field GLOB '*s*'")
def hscan_page(spark, d):
    return H.hscan(order_hashes(spark, d), 0, pattern="*s*", count=2)


@book.add()
def hrandfield(spark, d):
    return H.hrandfield(order_hashes(spark, d), 1, seed=4)


_SLOT_STEP = "lambda c, i: CASE WHEN c & 32768 <> 0 THEN xor(c << 1, 4129) & 65535 ELSE (c << 1) & 65535 END"


@book.add(f"SELECT c_name AS key, (list_reduce(list_transform(range(1, length(c_name) + 1), lambda i: ascii(c_name[i])), lambda crc, b: list_reduce(range(8), {_SLOT_STEP}, xor(crc, b << 8)), 0) % 16384)::INT AS slot FROM customer")
def keyslot(spark, d):
    """The names have no braces, so all of a name is hashed; SQL goes bit by bit."""
    return read_table(spark, d, "customer").select(F.col("c_name").alias("key"), key_slot(F.col("c_name")).alias("slot"))


QUERIES, ORACLES = book.queries, book.oracles
