"""List, bitmap, publish/subscribe, blocking-queue, log-replay and transaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import bitmaps as B
from keyloom.operators import blocking, pubsub
from keyloom.operators import lists as L
from keyloom.plans import replay, transactions
from keyloom.queries import Book
from keyloom.sources.spaces import click_lists, order_log, user_bits
from keyloom.sources.tables import read_table

book = Book()

LIST = "li AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS value FROM events)"
SIZED = f"{LIST}, s AS (SELECT *, count(*) OVER (PARTITION BY key) AS n FROM li)"
BITS = "b AS (SELECT DISTINCT event_type AS key, user_id AS bit FROM events)"


@book.add(f"WITH {SIZED} SELECT key, pos, value FROM s WHERE pos >= n - 3 AND pos <= n - 1")
def lrange(spark, d):
    return L.lrange(click_lists(spark, d), -3, -1)


@book.add(f"WITH {SIZED} SELECT key, pos, value FROM s WHERE pos >= 4 AND pos <= n - 3")
def lrange_mixed(spark, d):
    return L.lrange(click_lists(spark, d), 4, -3)


@book.add(f"WITH {LIST} SELECT * FROM li WHERE pos = 2")
def lindex(spark, d):
    return L.lindex(click_lists(spark, d), 2)


@book.add(f"WITH {LIST} SELECT key, count(*) AS n FROM li GROUP BY key")
def llen(spark, d):
    return L.llen(click_lists(spark, d))


@book.add(f"WITH {LIST}, r AS (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS rn FROM li) SELECT key, pos, value FROM r WHERE NOT (value = 'click' AND rn <= 2)")
def lrem(spark, d):
    return L.lrem(click_lists(spark, d), -2, "click")


@book.add(f"WITH {SIZED} SELECT key, pos, value FROM s WHERE pos >= 1 AND pos <= n - 2")
def ltrim(spark, d):
    return L.ltrim(click_lists(spark, d), 1, -2)


@book.add(f"WITH {LIST}, r AS (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY pos DESC) AS rn FROM li) SELECT key, pos AS index FROM r WHERE value = 'purchase' AND rn BETWEEN 2 AND 3")
def lpos(spark, d):
    return L.lpos(click_lists(spark, d), "purchase", rank=-2, count=2)


@book.add(f"WITH {LIST}, p AS (SELECT key, min(pos) AS place FROM li WHERE value = 'error' GROUP BY key), a AS (SELECT li.key, pos, value, 1 AS s FROM li UNION ALL SELECT key, place, 'mid', 0 FROM p) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos, s) - 1 AS pos, value FROM a")
def linsert(spark, d):
    return L.linsert(click_lists(spark, d), "error", "mid", before=True)


@book.add(f"WITH {LIST} SELECT key, pos, CASE WHEN pos = 1 THEN 'new' ELSE value END AS value FROM li")
def lset(spark, d):
    return L.lset(click_lists(spark, d), 1, "new")


@book.add(f"WITH {LIST} SELECT key, pos, value FROM li WHERE key = 5 AND pos < 4")
def lmpop(spark, d):
    return L.lmpop(click_lists(spark, d), [-1, 5, 3], 4)


@book.add(f"WITH {LIST}, m AS (SELECT max(pos) AS last FROM li WHERE key = 3), a AS (SELECT CASE WHEN key = 3 AND pos = last THEN 4 ELSE key END AS key, CASE WHEN key = 3 AND pos = last THEN -1 ELSE pos END AS pos, value FROM li, m) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS pos, value FROM a")
def lmove_batch(spark, d):
    return L.lmove(click_lists(spark, d), 3, 4, take_right=True)


@book.add("SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type = 'click' THEN -event_id - 1 ELSE event_id + 1 END) - 1 AS pos, event_type AS value FROM events")
def lpush_rpush(spark, d):
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "L").otherwise("R").alias("side"), F.col("event_type").alias("value"))
    return L.push(e)


#: Kinds of events, and the value from which on one counts: so the sets of users differ.
KINDS = (("click", 120), ("view", 100), ("error", 110))


def _valued(spark, d, bounds):
    """(key, bit): the users with an event of a kind above its bound."""
    e = read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit"), "value")
    bound = F.create_map(*[F.lit(x) for kind in bounds for x in kind])
    return e.where(F.col("value") > bound[F.col("key")]).select("key", "bit").distinct()


def _users(spark, d, *kinds):
    b = _valued(spark, d, kinds)
    return [b.where(F.col("key") == k).select("bit") for k, _ in kinds]


def _some(k: str, low: int) -> str:
    return f"(SELECT DISTINCT user_id AS bit FROM events WHERE event_type = '{k}' AND value > {low})"


A, V, W = (_some(*k) for k in KINDS)
HIGH = 150
RARE = f"b AS (SELECT DISTINCT event_type AS key, user_id AS bit FROM events WHERE value > {HIGH})"


def _rare(spark, d):
    return _valued(spark, d, [(k, HIGH) for k in ("click", "view", "purchase", "signup", "error")])


@book.add(f"WITH {BITS} SELECT key, bit FROM b")
def setbit_rows(spark, d):
    log = read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit"), F.lit(1).alias("on"), F.col("event_id").alias("seq"))
    return B.setbit(log)


@book.add("SELECT key, bit FROM (SELECT event_type AS key, user_id AS bit, arg_max(value > 20, event_id) AS v FROM events GROUP BY 1, 2) WHERE v")
def setbit_clear(spark, d):
    log = read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit"), (F.col("value") > 20).cast("int").alias("on"), F.col("event_id").alias("seq"))
    return B.setbit(log)


@book.add(f"WITH {BITS} SELECT key, count(*) AS n FROM b GROUP BY key")
def bitcount(spark, d):
    return B.bitcount(user_bits(spark, d))


@book.add(f"WITH {BITS} SELECT key, count(*) AS n FROM (SELECT *, max(bit) OVER (PARTITION BY key) // 8 + 1 AS nb FROM b) WHERE bit >= 8 AND bit < 8 * (nb - 1) GROUP BY key")
def bitcount_range(spark, d):
    return B.bitcount(user_bits(spark, d), 1, -2)


@book.add(f"WITH {RARE} SELECT key, min(bit) AS bit FROM b GROUP BY key")
def bitpos(spark, d):
    return B.bitpos(_rare(spark, d), 1)


@book.add(f"WITH {BITS}, g AS (SELECT key, bit, row_number() OVER (PARTITION BY key ORDER BY bit) - 1 AS r, max(bit) OVER (PARTITION BY key) AS last FROM b) SELECT key, coalesce(min(r) FILTER (WHERE r <> bit), max(last) + 1) AS bit FROM g GROUP BY key")
def bitpos_zero(spark, d):
    return B.bitpos(user_bits(spark, d), 0)


@book.add(f"WITH {RARE}, n AS (SELECT key, (max(bit) // 8 + 1) * 8 AS n FROM b GROUP BY key), p AS (SELECT key, unnest(range(9, n - 5)) AS place FROM n) SELECT n.key, coalesce(min(place) FILTER (WHERE b.bit IS NULL), -1) AS bit FROM n LEFT JOIN p ON n.key = p.key LEFT JOIN b ON b.key = p.key AND b.bit = p.place GROUP BY n.key")
def bitpos_bits(spark, d):
    """The first 0 from the tenth bit on, not counting the last five."""
    return B.bitpos(_rare(spark, d), 0, 9, -6, unit="BIT")


@book.add(f"WITH {RARE}, n AS (SELECT key, (max(bit) // 8 + 1) * 8 AS n FROM b GROUP BY key) SELECT b.key, count(*) AS n FROM b JOIN n ON n.key = b.key WHERE bit >= 3 AND bit < n.n - 2 GROUP BY b.key")
def bitcount_bits(spark, d):
    return B.bitcount(_rare(spark, d), 3, -3, unit="BIT")


@book.add("SELECT event_type AS key, user_id AS bit, event_id AS seq, coalesce(lag((value > 20)::INT) OVER (PARTITION BY event_type, user_id ORDER BY event_id), 0) AS old FROM events")
def setbit_old(spark, d):
    return B.setbit_replies(_bit_log(spark, d))


def _bit_log(spark, d):
    return read_table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("bit"), (F.col("value") > 20).cast("int").alias("on"), F.col("event_id").alias("seq"))


@book.add("WITH l AS (SELECT event_type AS key, user_id AS bit, arg_max(value > 20, event_id) AS v FROM events GROUP BY 1, 2), u AS (SELECT DISTINCT user_id AS bit FROM events), k AS (SELECT DISTINCT event_type AS key FROM events) SELECT k.key, u.bit, coalesce(v, false)::INT AS value FROM k CROSS JOIN u LEFT JOIN l ON l.key = k.key AND l.bit = u.bit")
def getbit(spark, d):
    kinds = F.explode(F.array(*[F.lit(k) for k in ("click", "view", "purchase", "signup", "error")])).alias("key")
    request = read_table(spark, d, "events").select(F.col("user_id").alias("bit")).distinct().select(kinds, "bit")
    return B.getbit(B.setbit(_bit_log(spark, d)), request)


@book.add(f"SELECT * FROM ({A} INTERSECT {V} INTERSECT {W})")
def bitop_and(spark, d):
    return B.bitop("AND", _users(spark, d, *KINDS))


@book.add(f"SELECT * FROM ({A} UNION {V} UNION {W})")
def bitop_or(spark, d):
    return B.bitop("OR", _users(spark, d, *KINDS))


@book.add(f"SELECT bit FROM ({A} UNION ALL {V} UNION ALL {W}) GROUP BY bit HAVING count(*) % 2 = 1")
def bitop_xor(spark, d):
    return B.bitop("XOR", _users(spark, d, *KINDS))


@book.add(f"SELECT x AS bit FROM (SELECT unnest(range(0, (SELECT (max(user_id) // 8 + 1) * 8 FROM events WHERE event_type = 'click'))) AS x) WHERE x NOT IN {A}")
def bitop_not(spark, d):
    """As long as its source, which SETBIT has lengthened also where the last bits are 0 now."""
    log = _bit_log(spark, d).where("key = 'click'")
    return B.bitop("NOT", _users(spark, d, KINDS[0]), B.bytes_written(log).select("n_bytes"))


@book.add(f"SELECT * FROM ({A} EXCEPT ({V} UNION {W}))")
def bitop_diff(spark, d):
    return B.bitop("DIFF", _users(spark, d, *KINDS))


#: Who listens to what.
SUBSCRIPTIONS = [("s1", "click"), ("s1", "view"), ("s2", "purchase"), ("s3", "click"), ("s3", "nothing")]
PATTERNS = [("s2", "p*"), ("s3", "*r*"), ("s4", "vie?"), ("s5", "z*")]
_SUBS = ", ".join(f"('{s}', '{c}')" for s, c in SUBSCRIPTIONS)
_PATS = ", ".join(f"('{s}', '{c}')" for s, c in PATTERNS)


@book.add(f"WITH subs(session, channel) AS (VALUES {_SUBS}), pats(session, pattern) AS (VALUES {_PATS}) SELECT event_id, event_type AS channel, session, NULL AS pattern FROM events JOIN subs ON event_type = channel UNION ALL SELECT event_id, event_type, session, pattern FROM events JOIN pats ON event_type GLOB pattern")
def publish_fanout(spark, d):
    exact = spark.createDataFrame(SUBSCRIPTIONS, "session string, channel string")
    messages = read_table(spark, d, "events").select("event_id", F.col("event_type").alias("channel"))
    return pubsub.fanout(messages, exact, PATTERNS)


@book.add(f"WITH subs(session, channel) AS (VALUES {_SUBS}) SELECT channel, count(DISTINCT session) AS n FROM subs GROUP BY channel")
def pubsub_numsub(spark, d):
    return pubsub.numsub(spark.createDataFrame(SUBSCRIPTIONS, "session string, channel string"))


DAY = 86_400_000
#: Requests are views, items clicks; one event after the other moves each user's two queues.
_QUEUE = f"""WITH RECURSIVE e AS (
  SELECT user_id AS key, event_id AS id, epoch_us(ts) // 1000 AS t, event_type = 'view' AS asks,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_type = 'view', event_id) AS n
  FROM events WHERE event_type IN ('view', 'click')
), s AS (
  SELECT DISTINCT key, 0::BIGINT AS n, []::BIGINT[] AS items, []::STRUCT(id BIGINT, t BIGINT)[] AS waiting,
         NULL::BIGINT AS req, NULL::BIGINT AS item, NULL::BIGINT AS wait FROM e
  UNION ALL
  SELECT key, n,
    CASE WHEN asks THEN items[2:] WHEN len(still) > 0 THEN items ELSE list_append(items, id) END,
    CASE WHEN asks AND len(items) = 0 THEN list_append(still, {{'id': id, 't': t}}) WHEN NOT asks AND len(still) > 0 THEN still[2:] ELSE still END,
    CASE WHEN asks AND len(items) > 0 THEN id WHEN NOT asks AND len(still) > 0 THEN still[1].id END,
    CASE WHEN asks AND len(items) > 0 THEN items[1] WHEN NOT asks AND len(still) > 0 THEN id END,
    CASE WHEN asks AND len(items) > 0 THEN 0 WHEN NOT asks AND len(still) > 0 THEN t - still[1].t END
  FROM (SELECT e.*, s.items, list_filter(s.waiting, lambda w: e.t <= w.t + {{timeout}}) AS still FROM s JOIN e ON e.key = s.key AND e.n = s.n + 1)
)
SELECT e.key, e.id AS req, s.item, s.wait FROM e LEFT JOIN s ON s.req = e.id WHERE e.asks"""


def _queue(spark, d, timeout):
    e = read_table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select("key", F.col("event_id").alias(name), "at")
    return blocking.blpop(side("view", "req"), side("click", "item"), timeout)


@book.add(_QUEUE.replace("{timeout}", str(DAY)))
def blpop_match(spark, d):
    return _queue(spark, d, DAY)


@book.add(_QUEUE.replace("{timeout}", str(DAY // 24)))
def blpop_hour(spark, d):
    """With a timeout that many requests do not live to see an item in."""
    return _queue(spark, d, DAY // 24)


@book.add("SELECT key, value FROM (SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value, arg_max(o_totalprice, o_orderkey) AS p FROM orders GROUP BY 1) WHERE p < 400000")
def replay_strings(spark, d):
    o = read_table(spark, d, "orders")
    cmd = F.when(F.col("o_totalprice") >= 400000, "DEL").otherwise("SET")
    log = o.select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), cmd.alias("cmd"), F.array(F.col("o_orderstatus")).alias("args"))
    return replay.strings(log)


@book.add("SELECT c_nationkey AS key, c_name AS member, sum(floor(o_totalprice / 1000))::DOUBLE AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def replay_zset(spark, d):
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    log = o.select(F.col("c_nationkey").alias("key"), F.col("o_orderkey").alias("seq"), F.lit("ZINCRBY").alias("cmd"), F.array(F.floor(F.col("o_totalprice") / 1000).cast("string"), F.col("c_name")).alias("args"))
    return replay.zsets(log)


@book.add("SELECT key, CASE WHEN key IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'T' ELSE value END AS value FROM (SELECT o_custkey AS key, arg_max(o_orderstatus, o_orderkey) AS value FROM orders GROUP BY 1)")
def multi_exec(spark, d):
    from keyloom.operators.strings import set_last

    kv = set_last(order_log(spark, d))
    some = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    batch = kv.join(some, "key", "left_semi").select("key", F.lit(1).alias("seq"), F.lit("T").alias("value"))
    versions = order_log(spark, d).groupBy("key").agg(F.max("seq").alias("version"))
    return transactions.execute(kv, batch, watched=versions, current=versions)


QUERIES, ORACLES = book.queries, book.oracles
