"""Queries of commands with options, replies or several effects, over all structures."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.scripts import ScriptRegistry
from keyloom.operators import blocking, hll, pubsub, range_index
from keyloom.operators import geo as G
from keyloom.operators import hashes as H
from keyloom.operators import keyspace as K
from keyloom.operators import lists as L
from keyloom.operators import sets as S
from keyloom.operators import strings as T
from keyloom.operators import vectors as V
from keyloom.operators import zsets as Z
from keyloom.plans import replay, transactions
from keyloom.queries import Book
from keyloom.queries.keys import EXP, HASH, LOG, NOW, SEGMENT, VOL, _segment, _volatile
from keyloom.queries.sequences import LIST, PATTERNS, SUBSCRIPTIONS
from keyloom.queries.sorted_sets import ACCT, ADDS, CUST, _adds
from keyloom.queries.spatial import PLACES, _haversine, stored_index, stored_places
from keyloom.sources.spaces import accounts, brand_sizes, click_lists, customers_by_priority, expiring_events, order_hashes, order_log, part_quantities, vectors
from keyloom.sources.tables import read_table

book = Book()

LAST = "SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key"


def _last(spark, d):
    return T.set_last(order_log(spark, d))


# Strings with deadlines: a customer's string expires as an event does; one event in six is a customer's.


def _expiring_strings(spark, d):
    at = expiring_events(spark, d).withColumn("key", F.col("key") / 6)
    return _last(spark, d).join(at, "key", "left")


KV = f"{LOG}, {EXP}, kv AS (SELECT l.key, l.value, ex.expire_at FROM ({LAST}) l LEFT JOIN ex ON ex.key = l.key * 6)"
ALIVE = f"{KV}, alive AS (SELECT * FROM kv WHERE expire_at IS NULL OR expire_at > {NOW})"
#: Writes to the strings of all customers, whether they have one or not.
WRITES = "w AS (SELECT c_custkey AS key, c_mktsegment AS value, CASE WHEN c_acctbal >= 1 THEN floor(c_acctbal)::BIGINT END AS ttl FROM customer)"


def _writes(spark, d):
    c = read_table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("key"), F.lit(1).alias("seq"), F.col("c_mktsegment").alias("value"), F.when(F.col("c_acctbal") >= 1, F.floor("c_acctbal")).alias("ttl"))


def _set(spark, d, **how):
    return T.set_with(_expiring_strings(spark, d), T.deadlines(_writes(spark, d), NOW, "EX"), NOW, **how)


def _set_sql(wins: str, due: str) -> str:
    return f"WITH {ALIVE}, {WRITES}, b AS (SELECT coalesce(w.key, a.key) AS key, w.key IS NOT NULL AS asked, a.key IS NOT NULL AS had, w.value AS new, {NOW} + w.ttl * 1000 AS new_at, a.value AS old, a.expire_at AS old_at FROM w FULL JOIN alive a ON a.key = w.key) SELECT key, CASE WHEN {wins} THEN new ELSE old END AS value, CASE WHEN {wins} THEN {due} ELSE old_at END AS expire_at FROM b WHERE had OR {wins}"


@book.add(_set_sql("asked", "new_at"))
def set_ex(spark, d):
    return _set(spark, d)[1]


@book.add(_set_sql("asked AND NOT had", "new_at"))
def set_nx_ex(spark, d):
    return _set(spark, d, mode="NX")[1]


@book.add(_set_sql("asked AND had", "old_at"))
def set_xx_keepttl(spark, d):
    return _set(spark, d, mode="XX", keepttl=True)[1]


@book.add(f"WITH {ALIVE}, {WRITES} SELECT w.key, a.value AS old FROM w LEFT JOIN alive a ON a.key = w.key")
def set_get(spark, d):
    return _set(spark, d)[0]


@book.add(f"WITH {KV} SELECT key, value, {NOW} + 90000 AS expire_at FROM kv")
def setex(spark, d):
    """SETEX and PSETEX: every write has a deadline."""
    log = order_log(spark, d).withColumn("ttl", F.lit(90))
    return T.set_with(_expiring_strings(spark, d), T.deadlines(log, NOW, "EX"), NOW)[1]


@book.add(f"WITH {ALIVE} SELECT c_custkey AS key, value FROM customer LEFT JOIN alive ON key = c_custkey")
def getex(spark, d):
    keys = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return K.getex(_expiring_strings(spark, d), keys, NOW, F.lit(NOW + 1000))[0]


@book.add(f"WITH {ALIVE} SELECT key, value, CASE WHEN key IN ({SEGMENT}) THEN NULL ELSE expire_at END AS expire_at FROM alive")
def getex_persist(spark, d):
    return K.getex(_expiring_strings(spark, d), _segment(spark, d), NOW, drop=True)[1]


@book.add(f"WITH {LOG} SELECT * FROM ({LAST}) WHERE key NOT IN ({SEGMENT})")
def getdel_rest(spark, d):
    return T.getdel(_last(spark, d), _segment(spark, d))[1]


@book.add(f"WITH {LOG} SELECT key, CASE WHEN key IN ({SEGMENT}) THEN 'T' ELSE value END AS value FROM ({LAST})")
def mset(spark, d):
    new = _last(spark, d).join(_segment(spark, d), "key", "left_semi").select("key", F.lit("T").alias("value"))
    return T.upsert(_last(spark, d), new)


@book.add(f"WITH {EXP}, w AS (SELECT event_id AS key, {NOW} + round(value * 1000)::BIGINT AS new_at FROM events) SELECT w.key, (expire_at > {NOW} AND new_at < expire_at)::INT AS reply FROM w JOIN ex ON ex.key = w.key")
def expire_replies(spark, d):
    w = read_table(spark, d, "events").select(F.col("event_id").alias("key"), (NOW + F.round(F.col("value") * 1000).cast("long")).alias("new_at"))
    return K.expire_replies(expiring_events(spark, d), w, NOW, "LT")


@book.add("SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders")
def rename_self(spark, d):
    return K.rename(customers_by_priority(spark, d), "1-URGENT", "1-URGENT")


@book.add("SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders")
def renamenx_taken(spark, d):
    return K.rename(customers_by_priority(spark, d), "1-URGENT", "5-LOW", nx=True)


@book.add("SELECT DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN '0-NOW' ELSE o_orderpriority END AS key, o_custkey AS member FROM orders")
def renamenx_free(spark, d):
    return K.rename(customers_by_priority(spark, d), "1-URGENT", "0-NOW", nx=True)


@book.add("SELECT key FROM (SELECT DISTINCT c_name AS key FROM customer ORDER BY key LIMIT 40 OFFSET 20) WHERE key GLOB '*[13579]'")
def scan_page(spark, d):
    return K.scan(read_table(spark, d, "customer").select(F.col("c_name").alias("key")), 20, pattern="*[13579]", count=40)


def _databases(spark, d):
    """Orders as keys: the nation of the customer is the tenant, the priority's digit the database."""
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("ns"), F.substring("o_orderpriority", 1, 1).cast("int").alias("db"), F.col("o_orderkey").alias("key"))


DATABASES = "dbs AS (SELECT c_nationkey AS ns, o_orderpriority[1]::INT AS db, o_orderkey AS key FROM orders JOIN customer ON o_custkey = c_custkey)"


@book.add(f"WITH {DATABASES} SELECT * FROM dbs WHERE ns = 3 AND db = 2")
def select_db(spark, d):
    return K.select_db(_databases(spark, d), 2, 3)


@book.add(f"WITH {DATABASES} SELECT * FROM dbs WHERE NOT (ns = 3 AND db = 2)")
def flushdb(spark, d):
    return K.flushdb(_databases(spark, d), 2, 3)


@book.add(f"WITH {DATABASES} SELECT * FROM dbs WHERE ns <> 3")
def flushall(spark, d):
    return K.flushall(_databases(spark, d), 3)


@book.add(f"WITH {DATABASES} SELECT ns, CASE WHEN ns = 3 AND db = 1 THEN 5 WHEN ns = 3 AND db = 5 THEN 1 ELSE db END AS db, key FROM dbs")
def swapdb(spark, d):
    return K.swapdb(_databases(spark, d), 1, 5, 3)


# Hashes


@book.add("SELECT user_id AS key, event_type AS field, CASE WHEN x = floor(x) THEN x::BIGINT::VARCHAR ELSE x::VARCHAR END AS value, NULL::BIGINT AS expire_at FROM (SELECT user_id, event_type, sum(round(value * 4) / 4) AS x FROM events GROUP BY 1, 2)")
def hincrbyfloat(spark, d):
    e = read_table(spark, d, "events")
    return H.hincrbyfloat(e.select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), (F.round(F.col("value") * 4) / 4).alias("delta")))


@book.add("SELECT user_id AS key, event_type AS field, arg_min(props, event_id) AS value FROM events WHERE event_type <> 'click' GROUP BY 1, 2")
def hsetnx(spark, d):
    """Fields that the hash has already (the clicks) are not written."""
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), F.col("props").alias("value"), F.col("event_id").alias("seq"))
    return H.hsetnx(e, e.where("field = 'click'"))


@book.add(f"WITH {HASH} SELECT key, field, strlen(value)::INT AS n FROM h UNION ALL SELECT o_orderkey, 'none', 0 FROM orders")
def hstrlen(spark, d):
    h = order_hashes(spark, d)
    return H.hstrlen(h, h.select("key", "field").union(read_table(spark, d, "orders").select("o_orderkey", F.lit("none"))))


@book.add(f"WITH {VOL} SELECT key, field, CASE WHEN expire_at > {NOW} THEN 1 ELSE -1 END AS code FROM vol")
def hpersist(spark, d):
    v = _volatile(spark, d)
    return H.hpersist(v, v.select("key", "field"), NOW)[0]


@book.add(f"WITH {VOL} SELECT key, count(*) FILTER (WHERE expire_at <= {NOW}) AS n FROM vol GROUP BY key")
def hcollect(spark, d):
    return H.hcollect(_volatile(spark, d), NOW)[0]


# Lists and queues


@book.add(f"WITH {LIST}, x AS (SELECT c_custkey AS key FROM customer), n AS (SELECT key, -1 AS pos, 'new' AS value FROM x WHERE key IN (SELECT key FROM li)), a AS (SELECT * FROM li UNION ALL SELECT * FROM n) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM a")
def lpushx(spark, d):
    log = read_table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit(1).alias("seq"), F.lit("L").alias("side"), F.lit("new").alias("value"))
    return L.pushx(log, click_lists(spark, d))


def _scored_events(spark, d):
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.round("value").alias("score"))
    req = e.where("event_type = 'view'").select("key", F.col("seq").alias("req"), "at", "seq")
    return req, e.where("event_type = 'click'").select("key", F.col("seq").alias("item"), "score", "at", "seq")


#: Requests are views, members clicks with their rounded value as score; one event after the other.
BZPOP = """WITH RECURSIVE e AS (
  SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS t, event_type = 'view' AS asks, round(value) AS score,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n
  FROM events WHERE event_type IN ('view', 'click')
), s AS (
  SELECT DISTINCT key, 0::BIGINT AS n, []::STRUCT(score DOUBLE, id VARCHAR)[] AS items, []::BIGINT[] AS waiting,
         NULL::BIGINT AS req, NULL::STRUCT(score DOUBLE, id VARCHAR) AS item FROM e
  UNION ALL
  SELECT s.key, e.n,
    CASE WHEN asks THEN list_sort(items)[2:] WHEN len(waiting) > 0 THEN items ELSE list_append(items, {'score': score, 'id': id::VARCHAR}) END,
    CASE WHEN asks AND len(items) = 0 THEN list_append(waiting, id) WHEN NOT asks AND len(waiting) > 0 THEN waiting[2:] ELSE waiting END,
    CASE WHEN asks AND len(items) > 0 THEN id WHEN NOT asks AND len(waiting) > 0 THEN waiting[1] END,
    CASE WHEN asks AND len(items) > 0 THEN list_sort(items)[1] WHEN NOT asks AND len(waiting) > 0 THEN {'score': score, 'id': id::VARCHAR} END
  FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1
)
SELECT e.key::VARCHAR AS key, e.id::VARCHAR AS req, s.item.id AS item, s.item.score AS score FROM e LEFT JOIN s ON s.req = e.id WHERE e.asks"""


@book.add(BZPOP)
def bzpopmin(spark, d):
    return blocking.bzpop(*_scored_events(spark, d), 0).select("key", "req", "item", "score")


# Sets and sorted sets


@book.add(f"WITH {CUST} SELECT * FROM cust WHERE NOT (key = '5-LOW' AND member IN ({SEGMENT})) UNION SELECT '1-URGENT', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def sadd_srem(spark, d):
    some = _segment(spark, d).withColumnRenamed("key", "member")
    s = S.sadd(customers_by_priority(spark, d), some.select(F.lit("1-URGENT").alias("key"), "member"))
    return S.srem(s, some.select(F.lit("5-LOW").alias("key"), "member"))


@book.add(f"WITH {CUST} SELECT 'first-only' AS key, member FROM cust WHERE key = '1-URGENT' EXCEPT SELECT 'first-only', member FROM cust WHERE key IN ('2-HIGH', '3-MEDIUM')")
def sdiffstore(spark, d):
    s = customers_by_priority(spark, d)
    return S.stored(S.sdiff(S.one(s, "1-URGENT"), [S.one(s, "2-HIGH"), S.one(s, "3-MEDIUM")]), "first-only")


@book.add(f"WITH {ACCT} SELECT * FROM acct WHERE member NOT IN (SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING')")
def zrem(spark, d):
    gone = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("member"))
    return Z.without(accounts(spark, d), gone)


def _swings(spark, d):
    """Increments of both signs: an order's price, in thousands, above 250."""
    return _adds(spark, d).withColumn("score", F.col("score") - 250)


SWINGS = f"{ADDS}, sw AS (SELECT key, member, score - 250 AS inc, seq FROM adds)"


@book.add(f"WITH {ACCT}, {SWINGS}, up AS (SELECT key, member, sum(inc) AS inc FROM sw WHERE inc > 0 GROUP BY 1, 2) SELECT a.key, a.member, score + coalesce(inc, 0) AS score FROM (SELECT key, member, floor(score) AS score FROM acct) a LEFT JOIN up ON up.key = a.key AND up.member = a.member")
def zadd_incr_gt(spark, d):
    """On members that exist only increments that raise the score apply."""
    return Z.zadd(accounts(spark, d).withColumn("score", F.floor("score").cast("double")), _swings(spark, d), incr=True, compare="GT")


@book.add(f"WITH {SWINGS}, f AS (SELECT *, row_number() OVER (PARTITION BY key, member ORDER BY seq) AS n FROM sw) SELECT key, member, sum(inc) FILTER (WHERE n = 1 OR inc < 0) AS score FROM f GROUP BY 1, 2")
def zadd_incr_lt_new(spark, d):
    """A member that is not there takes its first increment, then only those that lower its score."""
    return Z.zadd(accounts(spark, d).limit(0), _swings(spark, d), incr=True, compare="LT")


@book.add(f"WITH {ACCT}, {ADDS}, l AS (SELECT key, member, arg_max(score, seq) AS score FROM adds GROUP BY 1, 2) SELECT a.key, count(*) FILTER (WHERE l.score IS NOT NULL AND l.score <> a.score) AS n FROM acct a LEFT JOIN l ON l.key = a.key AND l.member = a.member GROUP BY a.key")
def zadd_ch(spark, d):
    z = accounts(spark, d)
    return Z.zadd_replies(z, Z.zadd(z, _adds(spark, d)), changed=True)


@book.add(f"WITH {ACCT}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS rn FROM acct) SELECT key, member, score FROM r WHERE rn > 4 AND rn <= 7")
def zrange_limit(spark, d):
    return Z.zrange(accounts(spark, d), 2, 20, rev=True, limit=(2, 3))


@book.add(f"WITH {ACCT} SELECT 'copy' AS key, member, 0.0::DOUBLE AS score FROM acct WHERE key = 7 AND member > 'Customer#000000100'")
def zrangestore_lex(spark, d):
    z = accounts(spark, d).where("key = 7")
    return Z.zrangestore(Z.zrangebylex(z, "(Customer#000000100", "+"), "copy", by_lex=True)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS rn FROM acct WHERE member <= 'Customer#000000700')")
def zrevrangebylex(spark, d):
    return Z.zrangebylex(accounts(spark, d), "-", "[Customer#000000700", rev=True)


@book.add("SELECT l_partkey AS member, sum(l_quantity) AS score, 'both' AS key FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 2")
def zinterstore(spark, d):
    z = part_quantities(spark, d)
    return Z.zrangestore(Z.zinter([z.where("key = 'A'"), z.where("key = 'R'")]), "both")


# What a seeded draw of members must hold, whatever is drawn


def _facts(picked, all_, element):
    """(key, n, distinct_n, known): how many were drawn, how many of them differ, and are of the key."""
    known = picked.join(all_.select("key", element).distinct().withColumn("_in", F.lit(1)), ["key", element], "left")
    return known.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(element).alias("distinct_n"), F.count("_in").alias("known"))


SIZES = "SELECT p_brand AS key, count(DISTINCT p_size) AS n FROM part GROUP BY 1"


@book.add(f"SELECT key, least(n, 4) AS n, least(n, 4) AS distinct_n, least(n, 4) AS known FROM ({SIZES})")
def srandmember_facts(spark, d):
    s = brand_sizes(spark, d)
    return _facts(S.srandmember(s, 4, seed=9), s, "member")


@book.add(f"SELECT key, 60 AS n, 60 AS known, true AS repeats FROM ({SIZES})")
def srandmember_repeats_facts(spark, d):
    s = brand_sizes(spark, d)
    return _facts(S.srandmember(s, -60, seed=9), s, "member").select("key", F.col("n").cast("int").alias("n"), F.col("known").cast("int").alias("known"), (F.col("distinct_n") < 60).alias("repeats"))


@book.add(f"SELECT key, greatest(0, n - 3) AS n FROM ({SIZES}) WHERE n > 3")
def spop_rest_facts(spark, d):
    return S.scard(S.spop(brand_sizes(spark, d), 3, seed=1)[1])


@book.add(f"WITH {ACCT} SELECT key, least(count(*), 5) AS n, least(count(*), 5) AS distinct_n, least(count(*), 5) AS known FROM acct GROUP BY key")
def zrandmember_facts(spark, d):
    z = accounts(spark, d)
    return _facts(Z.zrandmember(z, 5, seed=3), z, "member")


@book.add(f"WITH {HASH} SELECT key, 1 AS n, 1 AS distinct_n, 1 AS known FROM h GROUP BY key")
def hrandfield_facts(spark, d):
    h = order_hashes(spark, d)
    return _facts(H.hrandfield(h, 1, seed=4), h, "field").select("key", *[F.col(c).cast("int").alias(c) for c in ("n", "distinct_n", "known")])


@book.add("SELECT label AS key, least(count(*), 6) AS n, least(count(*), 6) AS distinct_n, least(count(*), 6) AS known FROM embeddings GROUP BY 1")
def vrandmember_facts(spark, d):
    v = vectors(spark, d)
    return _facts(V.vrandmember(v, 6, seed=2), v, "elem")


# Sketches: within five percent of the exact count


def _close(estimates, elems):
    exact = elems.groupBy("key").agg(F.count_distinct("elem").alias("exact"))
    return estimates.join(exact, "key").select("key", "exact", (F.abs(F.col("n") - F.col("exact")) <= 0.05 * F.col("exact")).alias("close"))


def _elems(spark, d):
    return part_quantities(spark, d).select("key", F.col("member").alias("elem"))


EXACT = "SELECT l_returnflag AS key, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem GROUP BY 1"


@book.add(EXACT)
def pfcount_close(spark, d):
    return _close(hll.pfcount(hll.pfadd(_elems(spark, d))), _elems(spark, d))


@book.add(EXACT)
def hll_estimate_close(spark, d):
    return _close(hll.estimate(hll.registers(_elems(spark, d))), _elems(spark, d))


@book.add("SELECT count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem")
def pfmerge_close(spark, d):
    union = hll.merged(hll.registers(_elems(spark, d))).withColumn("key", F.lit("all"))
    return _close(hll.estimate(union), _elems(spark, d).withColumn("key", F.lit("all"))).select("exact", "close")


@book.add("SELECT DISTINCT l_returnflag AS key, 0 AS changed FROM lineitem")
def pfadd_again(spark, d):
    """Elements that were added before change no register."""
    return hll.changed(hll.registers(_elems(spark, d)), _elems(spark, d))


# Places, vectors, range indexes


@book.add(f"WITH {PLACES}, c AS (SELECT lon AS clon, lat AS clat FROM pos WHERE key = 4 ORDER BY member LIMIT 1), q AS (SELECT key, member, {_haversine('clon', 'clat', 'lon', 'lat')} / 1000 AS dist FROM pos, c) SELECT key, member, round(dist, 3) AS dist FROM q WHERE dist <= 2000")
def georadius_member(spark, d):
    z = stored_places(spark, d)
    least = z.where("key = 4").agg(F.min("member").alias("m")).first()["m"]
    return G.geosearch_member(z, least, radius=2000, unit="km").select("key", "member", F.round("dist", 3).alias("dist"))


@book.add("SELECT label AS key, vec_id AS elem FROM embeddings")
def vadd(spark, d):
    """An element that is added again keeps its first vector."""
    v = vectors(spark, d)
    twice = v.withColumn("seq", F.lit(1)).union(v.withColumn("vec", F.transform("vec", lambda x: -x)).withColumn("seq", F.lit(2)))
    held = V.vadd(twice).join(v.withColumnRenamed("vec", "_was"), ["key", "elem"])
    return held.where(F.col("vec") == F.col("_was")).select("key", "elem")


@book.add("SELECT k.key, e.vec_id AS elem, (e.label = k.key)::INT AS is_member FROM embeddings e, (SELECT DISTINCT label AS key FROM embeddings) k")
def vismember(spark, d):
    v = vectors(spark, d)
    return V.vismember(v, v.select("elem").join(F.broadcast(v.select("key").distinct()), how="cross"))  # few labels


@book.add("SELECT label AS key, vec_id AS elem, CASE WHEN embedding[1] > 0 THEN 'up' END AS attr FROM embeddings")
def vsetattr(spark, d):
    """Every element gets an attribute, then those that point down have theirs cleared."""
    v = vectors(spark, d)
    log = v.select("key", "elem", F.lit("up").alias("attr"), F.lit(1).alias("seq")).union(v.where("NOT vec[0] > 0").select("key", "elem", F.lit(""), F.lit(2)))
    none = log.select("key", "elem", "attr").limit(0)
    return V.vgetattr(v, V.vsetattr(none, log, v))


@book.add("SELECT label AS key, 'f32' AS quant_type, max(len(embedding)) AS vector_dim, count(*) AS size FROM embeddings GROUP BY 1")
def vinfo(spark, d):
    return V.vinfo(vectors(spark, d))


@book.add("SELECT printf('%010d', o_orderkey) AS k, CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'P'")
def riset_ridel(spark, d):
    o = read_table(spark, d, "orders").select(F.format_string("%010d", "o_orderkey").alias("k"), "o_orderstatus")
    index = range_index.riset(stored_index(spark, d), o.where("o_orderstatus = 'F'").select("k", F.lit(-1.0).alias("v")))
    return range_index.ridel(index, o.where("o_orderstatus = 'P'"))


@book.add("SELECT printf('%010d', k) AS k, o_totalprice AS v FROM (SELECT unnest([c_custkey * 7, -c_custkey]) AS k FROM customer) LEFT JOIN orders ON o_orderkey = k")
def riget(spark, d):
    keys = read_table(spark, d, "customer").select(F.explode(F.array(F.col("c_custkey") * 7, -F.col("c_custkey"))).alias("n"))
    return range_index.riget(stored_index(spark, d), keys.select(F.format_string("%010d", "n").alias("k")))


@book.add("SELECT count(*) AS n, 10 * count(*) AS k_bytes, printf('%010d', min(o_orderkey)) AS first, printf('%010d', max(o_orderkey)) AS last FROM orders")
def rimetrics(spark, d):
    return range_index.rimetrics(stored_index(spark, d)).select("n", "k_bytes", "first", "last")


# Channels, scripts, logs, transactions

_SUBS = ", ".join(f"('{s}', '{c}')" for s, c in SUBSCRIPTIONS)
_PATS = ", ".join(f"('{s}', '{p}')" for s, p in PATTERNS)


@book.add(f"SELECT DISTINCT channel FROM (VALUES {_SUBS}) t(session, channel) WHERE channel GLOB '*i*'")
def pubsub_channels(spark, d):
    return pubsub.channels(spark.createDataFrame(SUBSCRIPTIONS, "session string, channel string"), "*i*")


@book.add(f"SELECT count(DISTINCT pattern) AS n FROM (VALUES {_PATS}) t(session, pattern)")
def pubsub_numpat(spark, d):
    return pubsub.numpat(spark.createDataFrame(PATTERNS, "session string, pattern string"))


@book.add("SELECT p_partkey AS key, p_brand || ':' || upper(p_name) AS value FROM part")
def evalsha(spark, d):
    scripts = ScriptRegistry()
    sha = scripts.load("def run(keys, args):\n    return keys[0] + args[0] + keys[1].str.upper()")
    return read_table(spark, d, "part").select(F.col("p_partkey").alias("key"), scripts.evaluate_sha(sha, [F.col("p_brand"), F.col("p_name")], [F.lit(":")]).alias("value"))


def _event_log(spark, d, cmd, *args):
    e = read_table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), cmd.alias("cmd"), F.array(*args).alias("args"))


def _switch(on, off, wipe=None):
    cmd = F.when(F.col("event_type") == "error", off).otherwise(on)
    return F.when(F.col("value") > 300, "DEL").otherwise(cmd) if wipe else cmd


EVENTS = "ev AS (SELECT user_id AS key, event_id AS seq, event_type AS kind, value, props FROM events), wiped AS (SELECT key, max(seq) AS at_ FROM ev WHERE value > 300 GROUP BY key), since AS (SELECT ev.* FROM ev LEFT JOIN wiped USING (key) WHERE NOT (value > 300) AND seq > coalesce(at_, -1))"
FIELD = "(seq % 7)::VARCHAR"


@book.add(f"WITH {EVENTS} SELECT key, {FIELD} AS field, arg_max(props, seq) AS value FROM since GROUP BY 1, 2 HAVING arg_max(kind, seq) <> 'error'")
def replay_hash(spark, d):
    """HSET, HDEL of the errors and DEL of the key where the value is high; the id's residue is the field."""
    return replay.hashes(_event_log(spark, d, _switch("HSET", "HDEL", True), (F.col("event_id") % 7).cast("string"), F.col("props")))


@book.add(f"WITH {EVENTS} SELECT key, {FIELD} AS member FROM since GROUP BY 1, 2 HAVING arg_max(kind, seq) <> 'error'")
def replay_set(spark, d):
    return replay.sets(_event_log(spark, d, _switch("SADD", "SREM", True), (F.col("event_id") % 7).cast("string")))


@book.add(f"WITH {EVENTS} SELECT key, {FIELD} AS k, arg_max(props, seq) AS v FROM since GROUP BY 1, 2 HAVING arg_max(kind, seq) <> 'error'")
def replay_range_index(spark, d):
    return replay.range_indexes(_event_log(spark, d, _switch("RI.SET", "RI.DEL", True), (F.col("event_id") % 7).cast("string"), F.col("props")))


@book.add("""WITH ev AS (SELECT user_id AS key, event_id AS seq, event_type AS kind, (event_id % 5)::VARCHAR AS member, round(value) AS x FROM events),
r AS (SELECT key, member, max(seq) AS from_, arg_max(CASE WHEN kind = 'signup' THEN x END, CASE WHEN kind = 'signup' OR kind = 'error' THEN seq END) AS unused FROM ev WHERE kind IN ('signup', 'error') GROUP BY 1, 2),
b AS (SELECT r.key, r.member, r.from_, CASE WHEN ev.kind = 'signup' THEN ev.x END AS base FROM r JOIN ev ON ev.key = r.key AND ev.member = r.member AND ev.seq = r.from_),
i AS (SELECT ev.key, ev.member, sum(x) AS by_ FROM ev LEFT JOIN b ON b.key = ev.key AND b.member = ev.member WHERE kind NOT IN ('signup', 'error') AND seq > coalesce(from_, -1) GROUP BY 1, 2)
SELECT coalesce(b.key, i.key) AS key, coalesce(b.member, i.member) AS member, coalesce(base, 0) + coalesce(by_, 0) AS score FROM b FULL JOIN i ON i.key = b.key AND i.member = b.member WHERE base IS NOT NULL OR by_ IS NOT NULL""")
def replay_zset_mixed(spark, d):
    """Signups add, errors remove, all others increment."""
    kind, x, member = F.col("event_type"), F.round("value").cast("string"), (F.col("event_id") % 5).cast("string")
    cmd = F.when(kind == "signup", "ZADD").when(kind == "error", "ZREM").otherwise("ZINCRBY")
    e = read_table(spark, d, "events")
    return replay.zsets(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), cmd.alias("cmd"), F.when(kind == "error", F.array(member)).otherwise(F.array(x, member)).alias("args")))


@book.add(f"WITH {LOG} SELECT key::VARCHAR AS key, CASE WHEN key IN ({SEGMENT}) THEN value || '!' ELSE value END AS value FROM ({LAST})")
def exec_commands(spark, d):
    """A batch of APPENDs under WATCH: nothing has moved, so all are applied."""
    log = order_log(spark, d)
    batch = _last(spark, d).join(_segment(spark, d), "key", "left_semi").select("key", F.lit(1).cast("long").alias("seq"), F.lit("APPEND").alias("cmd"), F.array(F.lit("!")).alias("args"))
    seen = transactions.versions(log)
    return transactions.execute_commands(_last(spark, d), batch, watched=seen, current=seen)


@book.add(f"WITH {LOG} {LAST}")
def exec_aborted(spark, d):
    """A watched key has moved, so the batch is dropped."""
    log = order_log(spark, d)
    batch = _last(spark, d).select("key", F.lit(1).alias("seq"), F.lit("T").alias("value"))
    seen = transactions.versions(log)
    return transactions.execute(_last(spark, d), batch, watched=seen.withColumn("version", F.col("version") - 1), current=seen)


QUERIES, ORACLES = book.queries, book.oracles
