import random

from keyloom.operators import bitmaps as B
from keyloom.operators import blocking
from keyloom.operators import hashes as H
from keyloom.operators import keyspace as K
from keyloom.operators import lists as L
from keyloom.operators import zsets as Z
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_getex(spark):
    kv = spark.createDataFrame([("a", "1", None), ("b", "2", 200), ("c", "3", 50)], "key string, value string, expire_at long")
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "key string")
    reply, after = K.getex(kv, keys, 100, F.lit(300))
    assert rows(reply) == [("a", "1"), ("b", "2"), ("c", None), ("d", None)]
    assert rows(after.select("key", "expire_at")) == [("a", 300), ("b", 300)]
    assert rows(K.getex(kv, keys, 100)[1].select("key", "expire_at")) == [("a", None), ("b", 200)]
    assert rows(K.getex(kv, keys, 100, drop=True)[1].select("key", "expire_at")) == [("a", None), ("b", None)]
    assert rows(K.getex(kv, keys.where("key = 'b'"), 100, F.lit(100))[1].select("key")) == [("a",)]


def test_field_and_member_expiry(spark):
    data = [("k", "a", 1.0, None), ("k", "b", 2.0, 5500), ("k", "c", 3.0, 50)]
    z = spark.createDataFrame(data, "key string, member string, score double, expire_at long")
    h = z.withColumnRenamed("member", "field")
    ask = spark.createDataFrame([("k", m) for m in "abcd"], "key string, member string")
    reply, after = H.hpersist(h, ask.withColumnRenamed("member", "field"), 100)
    assert rows(reply) == [("k", "a", -1), ("k", "b", 1), ("k", "c", -1), ("k", "d", -1)]
    assert rows(after.select("field", "expire_at")) == [("a", None), ("b", None)]
    assert [rows(x) for x in H.hcollect(h.drop("score"), 100)] == [[("k", 1)], [("k", "a", None), ("k", "b", 5500)]]
    assert rows(Z.zttl(z, ask, 100)) == [("k", "a", -1), ("k", "b", 5400), ("k", "c", -2), ("k", "d", -2)]
    assert rows(Z.zexpiretime(z, ask, 100)) == [("k", "a", -1), ("k", "b", 5), ("k", "c", -2), ("k", "d", -2)]
    reply, after = Z.zpersist(z, ask, 100)
    assert rows(reply) == [("k", "a", False), ("k", "b", True), ("k", "c", False), ("k", "d", False)]
    assert rows(after.select("member", "expire_at")) == [("a", None), ("b", None)]
    assert [x.count() for x in Z.zcollect(z, 100)] == [1, 2]
    for condition, new_at, codes, left in (("", 9000, [1, 1], [9000, 9000]), ("NX", 9000, [1, 0], [9000, 5500]), ("XX", 9000, [0, 1], [None, 9000]), ("GT", 9000, [0, 1], [None, 9000]), ("LT", 9000, [1, 0], [9000, 5500]), ("", 100, [2, 2], [])):
        reply, after = Z.zexpire(z, ask.withColumn("new_at", F.lit(new_at)), 100, condition)
        assert [r[2] for r in rows(reply)] == [*codes, -2, -2]
        assert [r[3] for r in rows(after.select("key", "member", "score", "expire_at"))] == left


def test_bitcount_of_bits(spark):
    bits = spark.createDataFrame([("k", i) for i in (0, 3, 5, 9, 12, 15)], "key string, bit long")
    for start in range(-18, 19, 3):
        for end in range(-18, 19, 2):
            lo, hi = (max(0, start + 16) if start < 0 else start), (end + 16 if end < 0 else end)
            want = sum(lo <= b <= hi for b in (0, 3, 5, 9, 12, 15))
            if (start + end) % 4 == 0:
                assert rows(B.bitcount(bits, start, end, unit="BIT")) == ([("k", want)] if want else [])


def played(events, timeout, last, scored):
    """One event after the other, over all keys."""
    items, waiters, out, came = {}, {}, [], 0
    for at, seq, key, kind, name, score, n in sorted(events):
        have, wait = items.setdefault(key, {}), waiters.setdefault(key, [])
        came += 1
        if kind == "pop":
            order = sorted(have, key=lambda m: (have[m], m), reverse=last)[:n]  # noqa: B023
            out += [(key, name, m, have.pop(m) if scored else None, 0) if scored else (key, name, m, have.pop(m) and 0) for m in order]
            if not order:
                wait.append((name, at))
            continue
        late = [w for w in wait if timeout and at > w[1] + timeout]
        wait[:] = [w for w in wait if w not in late]
        out += [(key, w[0], None, None, None)[: 5 if scored else 4] for w in late]
        if wait:
            req, asked = wait.pop(0)
            out.append((key, req, name, score, at - asked) if scored else (key, req, name, at - asked))
        else:
            have[name] = score if scored else came
    out += [(key, w[0], None, None, None)[: 5 if scored else 4] for key, ws in waiters.items() for w in ws]
    return sorted(out, key=repr)


def test_blocking_pops_equal_one_by_one_play(spark):
    rng = random.Random(3)
    for scored in (True, False):
        events = []
        for seq in range(300):
            kind = rng.choice(["push", "pop"])
            name = f"r{seq}" if kind == "pop" else f"m{rng.randrange(20)}" if scored else f"i{seq}"
            events.append((seq // 3 * 7, seq, rng.choice("ab"), kind, name, float(rng.randrange(9)), rng.randrange(1, 4)))
        every = spark.createDataFrame(events, "at long, seq long, key string, kind string, name string, score double, n int")
        req, arr = every.where("kind = 'pop'").withColumnRenamed("name", "req"), every.where("kind = 'push'").withColumnRenamed("name", "item")
        for timeout, last in ((0, False), (10, True), (10, False)):
            got = blocking.bzpop(req, arr, timeout, largest=last) if scored else blocking.blmpop(req, arr, timeout, right=last)
            assert rows(got) == played(events, timeout, last, scored)


def test_blmove(spark):
    req = spark.createDataFrame([("k", "r1", 1, 1, "d"), ("k", "r2", 5, 5, "d"), ("k", "r3", 6, 6, "d")], "key string, req string, at long, seq long, dest string")
    arr = spark.createDataFrame([("k", "x", 2, 2), ("k", "y", 3, 3), ("k", "z", 4, 4)], "key string, item string, at long, seq long")
    answers, pushes = blocking.blmove(req, arr, 0, take_right=True)
    assert rows(answers) == [("k", "r1", "d", "x", 1), ("k", "r2", "d", "z", 0), ("k", "r3", "d", "y", 0)]
    assert rows(L.push(pushes)) == [("d", 0, "y"), ("d", 1, "z"), ("d", 2, "x")]
