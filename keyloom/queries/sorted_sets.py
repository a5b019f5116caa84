"""Sorted-set and set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import sets as S
from keyloom.operators import zsets as Z
from keyloom.queries import Book
from keyloom.sources.spaces import accounts, brand_sizes, customers_by_priority, part_quantities, supplier_accounts
from keyloom.sources.tables import read_table

book = Book()

ACCT = "acct AS (SELECT c_nationkey AS key, c_name AS member, c_acctbal AS score FROM customer)"
PART = "pq AS (SELECT l_returnflag AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"
CUST = "cust AS (SELECT DISTINCT o_orderpriority AS key, o_custkey AS member FROM orders)"
P1, P2, P3 = "1-URGENT", "2-HIGH", "3-MEDIUM"


def _up(rank: str = "rn", rev: bool = False) -> str:
    d = " DESC" if rev else ""
    return f"row_number() OVER (PARTITION BY key ORDER BY score{d}, member{d}) AS {rank}"


def _flags(spark, d):
    z = part_quantities(spark, d)
    return [z.where(F.col("key") == k) for k in ("A", "N", "R")]


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up(rev=True)} FROM acct) WHERE rn <= 10")
def zrange_topk(spark, d):
    return Z.zrange(accounts(spark, d), 0, 9, rev=True)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up(rev=True)} FROM acct) WHERE rn BETWEEN 6 AND 9")
def zrevrange(spark, d):
    return Z.zrange(accounts(spark, d), 5, 8, rev=True)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up(rev=True)} FROM acct) WHERE rn BETWEEN 2 AND 4")
def zrange_index_neg(spark, d):
    return Z.zrange(accounts(spark, d), -4, -2)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up()}, count(*) OVER (PARTITION BY key) AS n FROM acct) WHERE rn >= 3 AND rn <= n - 2")
def zrange_index_mixed(spark, d):
    return Z.zrange(accounts(spark, d), 2, -3)


@book.add(f"WITH {ACCT} SELECT key, member, score, rn - 1 AS rank FROM (SELECT *, {_up()} FROM acct)")
def zrank(spark, d):
    return Z.zrank(accounts(spark, d))


@book.add(f"WITH {ACCT} SELECT key, member, score, rn - 1 AS rank FROM (SELECT *, {_up(rev=True)} FROM acct)")
def zrevrank(spark, d):
    return Z.zrank(accounts(spark, d), rev=True)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up()} FROM acct WHERE score > 1000 AND score <= 5000) WHERE rn > 2 AND rn <= 7")
def zrangebyscore_limit(spark, d):
    return Z.zrangebyscore(accounts(spark, d), "(1000", 5000, limit=(2, 5))


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up(rev=True)} FROM acct WHERE score >= 0) WHERE rn <= 3")
def zrevrangebyscore_limit(spark, d):
    return Z.zrangebyscore(accounts(spark, d), 0, "+inf", rev=True, limit=(0, 3))


@book.add(f"WITH {ACCT} SELECT key, count(*) AS n FROM acct WHERE score >= 0 AND score < 2500 GROUP BY key")
def zcount(spark, d):
    return Z.zcount(accounts(spark, d), 0, "(2500")


@book.add(f"WITH {ACCT} SELECT * FROM acct WHERE NOT (score >= 0 AND score <= 5000)")
def zremrangebyscore(spark, d):
    return Z.zremrangebyscore(accounts(spark, d), 0, 5000)


@book.add(f"WITH {ACCT} SELECT * FROM acct WHERE member >= 'Customer#000000100' AND member < 'Customer#000000900'")
def zrangebylex(spark, d):
    return Z.zrangebylex(accounts(spark, d), "[Customer#000000100", "(Customer#000000900")


@book.add(f"WITH {ACCT} SELECT key, count(*) AS n FROM acct WHERE member <= 'Customer#000000500' GROUP BY key")
def zlexcount(spark, d):
    return Z.zlexcount(accounts(spark, d), "-", "[Customer#000000500")


@book.add(f"WITH {ACCT} SELECT * FROM acct WHERE NOT (member > 'Customer#000000200')")
def zremrangebylex(spark, d):
    return Z.zremrangebylex(accounts(spark, d), "(Customer#000000200", "+")


@book.add(f"WITH {PART} SELECT member, sum(CASE key WHEN 'A' THEN 1.0 WHEN 'N' THEN 2.0 ELSE 0.5 END * score) AS score FROM pq GROUP BY member")
def zunion_sum_w(spark, d):
    return Z.zunion(_flags(spark, d), [1.0, 2.0, 0.5])


@book.add(f"WITH {PART} SELECT member, min(score) AS score FROM pq GROUP BY member")
def zunion_min(spark, d):
    return Z.zunion(_flags(spark, d), aggregate="MIN")


@book.add(f"WITH {PART} SELECT member, max(score) AS score FROM pq GROUP BY member")
def zunion_max(spark, d):
    return Z.zunion(_flags(spark, d), aggregate="MAX")


@book.add(f"WITH {PART} SELECT 'all' AS key, member, sum(score) AS score FROM pq GROUP BY member")
def zunionstore(spark, d):
    return Z.zunion(_flags(spark, d)).select(F.lit("all").alias("key"), "member", "score")


@book.add(f"WITH {PART} SELECT member, sum(CASE key WHEN 'A' THEN 3.0 WHEN 'N' THEN 1.0 ELSE 2.0 END * score) AS score FROM pq GROUP BY member HAVING count(*) = 3")
def zinter_sum_w(spark, d):
    return Z.zinter(_flags(spark, d), [3.0, 1.0, 2.0])


@book.add(f"WITH {PART} SELECT member, min(score) AS score FROM pq GROUP BY member HAVING count(*) = 3")
def zinter_min(spark, d):
    return Z.zinter(_flags(spark, d), aggregate="MIN")


@book.add(f"WITH {PART} SELECT least(100, count(*)) AS n FROM (SELECT member FROM pq GROUP BY member HAVING count(*) = 3)")
def zintercard(spark, d):
    return Z.zintercard(_flags(spark, d), 100)


@book.add(f"WITH {PART} SELECT member, score FROM pq WHERE key = 'A' AND member NOT IN (SELECT member FROM pq WHERE key = 'R' AND score > 100)")
def zdiff(spark, d):
    a, _, r = _flags(spark, d)
    return Z.zdiff(a, [r.where("score > 100")])


def _adds(spark, d):
    """Writes to the accounts: an order adds its price, in thousands, to its customer's member."""
    o = read_table(spark, d, "orders").join(read_table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("member"), F.floor(F.col("o_totalprice") / 1000).cast("double").alias("score"), F.col("o_orderkey").alias("seq"))


ADDS = "adds AS (SELECT c_nationkey AS key, c_name AS member, floor(o_totalprice / 1000)::DOUBLE AS score, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey)"


@book.add(f"WITH {ADDS} SELECT key, member, sum(score) AS score FROM adds GROUP BY 1, 2")
def zincrby_fold(spark, d):
    return Z.zadd(accounts(spark, d).limit(0), _adds(spark, d), mode="INCR")


@book.add(f"WITH {ACCT}, {ADDS} SELECT key, member, max(score) AS score FROM (SELECT key, member, score FROM acct UNION ALL SELECT key, member, score FROM adds) GROUP BY 1, 2")
def zadd_gt_fold(spark, d):
    return Z.zadd(accounts(spark, d), _adds(spark, d), compare="GT")


@book.add(f"WITH {ACCT}, {ADDS} SELECT key, member, min(score) AS score FROM (SELECT key, member, score FROM acct UNION ALL SELECT key, member, score FROM adds) GROUP BY 1, 2")
def zadd_lt_fold(spark, d):
    return Z.zadd(accounts(spark, d), _adds(spark, d), compare="LT")


@book.add(f"WITH {ADDS} SELECT key, member, arg_min(score, seq) AS score FROM adds GROUP BY 1, 2")
def zadd_nx_fold(spark, d):
    return Z.zadd(accounts(spark, d).limit(0), _adds(spark, d), mode="NX")


@book.add(f"WITH {ACCT}, {ADDS} SELECT a.key, a.member, coalesce(b.score, a.score) AS score FROM acct a LEFT JOIN (SELECT key, member, arg_max(score, seq) AS score FROM adds GROUP BY 1, 2) b ON a.key = b.key AND a.member = b.member")
def zadd_xx_fold(spark, d):
    return Z.zadd(accounts(spark, d), _adds(spark, d), mode="XX")


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up()} FROM acct) WHERE rn <= 3")
def zpopmin(spark, d):
    return Z.zpop(accounts(spark, d), 3)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up(rev=True)} FROM acct) WHERE rn <= 3")
def zpopmax(spark, d):
    return Z.zpop(accounts(spark, d), 3, largest=True)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up()} FROM acct WHERE key = 7) WHERE rn <= 4")
def zmpop(spark, d):
    return Z.zmpop(accounts(spark, d), [-1, 7, 3], 4)


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, {_up()} FROM acct) WHERE rn > 5")
def zremrangebyrank(spark, d):
    return Z.zremrangebyrank(accounts(spark, d), 0, 4)


@book.add("SELECT n_nationkey AS key, c_name AS member, CASE WHEN c_nationkey = n_nationkey THEN c_acctbal END AS score FROM nation CROSS JOIN customer WHERE c_mktsegment = 'BUILDING' ")
def zmscore(spark, d):
    names = read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_name").alias("member"))
    keys = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("key")
    return Z.zmscore(accounts(spark, d), names.select(keys, "member"))


@book.add(f"WITH {ACCT} SELECT key, count(*) AS n FROM acct GROUP BY key")
def zcard(spark, d):
    return Z.zcard(accounts(spark, d))


@book.add(f"WITH {ACCT}, sup AS (SELECT s_nationkey AS key, s_acctbal AS score FROM supplier) SELECT key, count(*) AS n FROM sup WHERE score >= 0 GROUP BY key")
def zcount_suppliers(spark, d):
    return Z.zcount(supplier_accounts(spark, d), 0, "+inf")


@book.add(f"WITH {ACCT} SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS rn FROM acct) WHERE rn > 10 AND rn <= 20 AND member GLOB '*[02468]'")
def zscan_page(spark, d):
    return Z.zscan(accounts(spark, d), 10, pattern="*[02468]", count=10)


@book.add()
def zrandmember(spark, d):
    return Z.zrandmember(accounts(spark, d), 5, seed=3)


def _sets(spark, d):
    s = customers_by_priority(spark, d)
    return [S.one(s, p) for p in (P1, P2, P3)]


@book.add(f"WITH {CUST} SELECT member FROM cust WHERE key = '{P1}' INTERSECT SELECT member FROM cust WHERE key = '{P2}' INTERSECT SELECT member FROM cust WHERE key = '{P3}'")
def sinter(spark, d):
    return S.sinter(_sets(spark, d))


@book.add(f"WITH {CUST} SELECT DISTINCT member FROM cust WHERE key IN ('{P1}', '{P2}', '{P3}')")
def sunion(spark, d):
    return S.sunion(_sets(spark, d))


@book.add(f"WITH {CUST} SELECT member FROM cust WHERE key = '{P1}' EXCEPT SELECT member FROM cust WHERE key IN ('{P2}', '{P3}')")
def sdiff(spark, d):
    a, *rest = _sets(spark, d)
    return S.sdiff(a, rest)


@book.add(f"WITH {CUST} SELECT least(50, count(*)) AS n FROM (SELECT member FROM cust WHERE key IN ('{P1}', '{P2}', '{P3}') GROUP BY member HAVING count(*) = 3)")
def sintercard(spark, d):
    return S.sintercard(_sets(spark, d), 50)


@book.add(f"WITH {CUST} SELECT key, count(*) AS n FROM cust GROUP BY key")
def scard(spark, d):
    return S.scard(customers_by_priority(spark, d))


@book.add(f"WITH {CUST}, keys AS (SELECT DISTINCT key FROM cust), req AS (SELECT key, c_custkey AS member FROM keys, customer) SELECT req.key, req.member, (cust.member IS NOT NULL)::INT AS is_member FROM req LEFT JOIN cust ON req.key = cust.key AND req.member = cust.member")
def smismember(spark, d):
    s = customers_by_priority(spark, d)
    names = F.explode(F.array(*[F.lit(k) for k in (P1, P2, P3, "4-NOT SPECIFIED", "5-LOW")])).alias("key")
    request = read_table(spark, d, "customer").select(names, F.col("c_custkey").alias("member"))
    return S.smismember(s, request)


@book.add(f"WITH {CUST} SELECT DISTINCT CASE WHEN key = '{P1}' AND member = (SELECT min(member) FROM cust WHERE key = '{P1}') THEN '5-LOW' ELSE key END AS key, member FROM cust")
def smove(spark, d):
    s = customers_by_priority(spark, d)
    least = S.one(s, P1).agg(F.min("member").alias("m")).first()["m"]
    return S.smove(s, P1, "5-LOW", least)


@book.add(f"WITH {CUST} SELECT 'urgent-or-high' AS key, member FROM cust WHERE key IN ('{P1}', '{P2}') GROUP BY member")
def sunionstore(spark, d):
    return S.stored(S.sunion(_sets(spark, d)[:2]), "urgent-or-high")


@book.add(f"WITH {CUST} SELECT 'both' AS key, member FROM cust WHERE key IN ('{P1}', '{P2}') GROUP BY member HAVING count(*) = 2")
def sinterstore(spark, d):
    return S.stored(S.sinter(_sets(spark, d)[:2]), "both")


@book.add("SELECT key, member FROM (SELECT p_brand AS key, p_size AS member, row_number() OVER (PARTITION BY p_brand ORDER BY p_size) AS rn FROM (SELECT DISTINCT p_brand, p_size FROM part)) WHERE rn <= 15 AND member::VARCHAR GLOB '1*'")
def sscan_page(spark, d):
    return S.sscan(brand_sizes(spark, d), 0, pattern="1*", count=15)


@book.add()
def spop(spark, d):
    return S.spop(brand_sizes(spark, d), 3, seed=1)[0]


@book.add()
def srandmember(spark, d):
    return S.srandmember(brand_sizes(spark, d), 4, seed=9)


QUERIES, ORACLES = book.queries, book.oracles
