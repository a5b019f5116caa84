import hashlib
import random

import pytest
from keyloom.functions.geo import geo_score, geo_text
from keyloom.functions.globs import glob_to_regex
from keyloom.functions.scripts import ScriptRegistry
from keyloom.functions.slots import key_slot
from keyloom.operators import bitmaps as B
from keyloom.operators import blocking, hashes, hll, pubsub, range_index, vectors
from keyloom.operators import geo as G
from keyloom.operators import keyspace as K
from keyloom.operators import lists as L
from keyloom.operators import sets as S
from keyloom.operators import strings as T
from keyloom.operators import zsets as Z
from keyloom.plans import replay, transactions
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def zs(spark):
    z = spark.createDataFrame([("z", "one", 10.0), ("z", "two", 20.0), ("z", "three", 30.0), ("z", "four", 40.0)], "key string, member string, score double")
    return z


def test_zset_ranges(zs):
    assert rows(Z.zrange(zs, 0, 1)) == [("z", "one", 10.0), ("z", "two", 20.0)]
    assert rows(Z.zrange(zs, 0, 1, rev=True)) == [("z", "four", 40.0), ("z", "three", 30.0)]
    assert rows(Z.zrange(zs, 1, -2)) == [("z", "three", 30.0), ("z", "two", 20.0)]
    assert rows(Z.zrange(zs, 0, -9)) == []
    assert rows(Z.zrangebyscore(zs, "(10", 30)) == [("z", "three", 30.0), ("z", "two", 20.0)]
    assert rows(Z.zrangebyscore(zs, 30, 10)) == rows(Z.zrangebyscore(zs, "nan", 10)) == rows(Z.zrangebyscore(zs, 10, "(10")) == []
    assert len(rows(Z.zrangebyscore(zs, "-inf", "+inf"))) == 4
    assert rows(Z.zremrangebyrank(zs, 0, 1)) == [("z", "four", 40.0), ("z", "three", 30.0)]


def test_zset_algebra(spark):
    make = lambda d: spark.createDataFrame(list(d.items()), "member string, score double")
    a, b = make({"a": 1.0, "b": 2.0}), make({"b": 10.0, "c": 20.0})
    assert rows(Z.zunion([a, b])) == [("a", 1.0), ("b", 12.0), ("c", 20.0)]
    x, y, z = make({"a": 1.0, "b": 2.0, "c": 3.0}), make({"b": 10.0, "c": 20.0, "d": 30.0}), make({"b": 100.0, "c": 200.0})
    assert rows(Z.zinter([x, y, z])) == [("b", 112.0), ("c", 223.0)]
    assert [rows(Z.zintercard([x, y, z], n)) for n in (0, 1, 5)] == [[(2,)], [(1,)], [(2,)]]
    assert rows(Z.zdiff(a, [b])) == [("a", 1.0)]
    inf = float("inf")
    assert rows(Z.zunion([make({"a": inf, "b": 1.0}), make({"a": -inf})])) == [("b", 1.0)]
    with pytest.raises(ValueError):
        Z.zunion([a, b], [1.0])


def test_zadd_modes(spark):
    z = spark.createDataFrame([("k", "a", 5.0)], "key string, member string, score double")
    log = spark.createDataFrame([("k", "a", 3.0, 1), ("k", "b", 1.0, 2), ("k", "b", 9.0, 3), ("k", "c", -0.0, 4)], "key string, member string, score double, seq long")
    assert rows(Z.zadd(z, log)) == [("k", "a", 3.0), ("k", "b", 9.0), ("k", "c", 0.0)]
    assert rows(Z.zadd(z, log, mode="NX")) == [("k", "a", 5.0), ("k", "b", 1.0), ("k", "c", 0.0)]
    assert rows(Z.zadd(z, log, mode="XX")) == [("k", "a", 3.0)]
    assert rows(Z.zadd(z, log, compare="GT")) == [("k", "a", 5.0), ("k", "b", 9.0), ("k", "c", 0.0)]
    assert rows(Z.zadd(z, log, mode="INCR")) == [("k", "a", 8.0), ("k", "b", 10.0), ("k", "c", 0.0)]


def test_sets(spark):
    make = lambda s: spark.createDataFrame([(c,) for c in s], "member string")
    a, b = make("abc"), make("bcd")
    assert rows(S.sinter([a, b])) == [("b",), ("c",)]
    assert len(rows(S.sunion([a, b]))) == 4 and rows(S.sdiff(a, [b])) == [("a",)]
    assert rows(S.sintercard([a, b], 1)) == [(1,)]
    s = spark.createDataFrame([("x", "m"), ("y", "n")], "key string, member string")
    assert rows(S.smove(s, "x", "y", "m")) == [("y", "m"), ("y", "n")]
    assert rows(S.smove(s, "x", "y", "absent")) == rows(s)
    gone, rest = S.spop(s, 1)
    assert len(rows(gone)) == 2 and rows(rest) == []


def test_strings(spark):
    log = spark.createDataFrame([("c", 1, 1), ("c", 2, 10), ("c", 3, -1), ("c", 4, -5)], "key string, seq long, delta long")
    assert [r["after"] for r in T.incr_running(log).orderBy("seq").collect()] == [1, 11, 10, 5]
    one = spark.createDataFrame([("This is a string", "é")], "s string, u string")
    got = one.select(T.getrange(F.col("s"), 0, 3).cast("string"), T.getrange(F.col("s"), -3, -1).cast("string"), T.getrange(F.col("s"), 5, 2).cast("string"), T.getrange(F.col("s"), 10, 100).cast("string"), T.strlen(F.col("u"))).first()
    assert tuple(got) == ("This", "ing", "", "string", 2)
    got = one.select(T.setrange(F.col("u"), 4, "x").alias("a"), T.setrange(F.col("s"), 0, "That").cast("string").alias("b")).first()
    assert bytes(got["a"]) == "é".encode() + b"\x00\x00x" and got["b"] == "That is a string"
    kv = spark.createDataFrame([("a", "1")], "key string, value string")
    assert rows(T.msetnx(kv, spark.createDataFrame([("a", "2"), ("b", "3")], kv.schema))) == [("a", "1")]
    assert rows(T.msetnx(kv, spark.createDataFrame([("b", "3")], kv.schema))) == [("a", "1"), ("b", "3")]
    with pytest.raises(Exception, match="(?i)overflow"):
        T.incr_net(spark.createDataFrame([("c", (1 << 63) - 1), ("c", 1)], "key string, delta long")).collect()


def test_keyspace(spark):
    df = spark.createDataFrame([("p", None), ("v", 5000), ("old", 10)], "key string, expire_at long")
    ask = spark.createDataFrame([("p",), ("v",), ("old",), ("none",)], "key string")
    assert rows(K.ttl(df, ask, 1001)) == [("none", -2), ("old", -2), ("p", -1), ("v", 4)]
    assert rows(K.expire(df, F.lit(9000), 1000, "NX").where("key = 'v'")) == [("v", 5000)]
    assert rows(K.expire(df, F.lit(500), 1000)) == []
    twice = spark.createDataFrame([("p",), ("p",), ("none",)], "key string")
    assert rows(K.exists(df, twice)) == [(2,)]
    s = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, member string")
    assert rows(K.rename(s, "a", "b")) == [("b", "1")] and rows(K.rename(s, "none", "b")) == rows(s)


def test_globs(spark):
    cases = [("[!0-9]ello", "hello", False, True), ("[z-a]", "m", True, True), ("*", "", False, True), ("*[ab]x", "zzzxax", True, True), ("[abc", "b", True, True)]
    cases = [(p, t, want) for p, t, want, _ in cases]
    df = spark.createDataFrame([(t,) for _, t, _ in cases], "t string")
    for p, t, want in cases:
        assert df.where(F.col("t") == t).select(F.col("t").rlike(glob_to_regex(p, keys=True))).first()[0] is want, (p, t)
    for p, t, want in [("*", "", True), ("h[ae]llo", "hello", True), ("h?llo", "hllo", False), ("h[!a]llo", "hello", True), ("[abc", "[abc", True), ("\\x41*", "Abc", True), ("a\\*", "a*", True)]:
        assert df.limit(1).select(F.lit(t).rlike(glob_to_regex(p))).first()[0] is want, (p, t)


def test_lists_against_a_model(spark):
    rng = random.Random(3)
    log, model = [], []
    for seq in range(200):
        side, v = rng.choice("LR"), rng.choice("abc")
        log.append(("k", seq, side, v))
        model = [v, *model] if side == "L" else [*model, v]
    items = L.push(spark.createDataFrame(log, "key string, seq long, side string, value string"))
    values = lambda df: [r["value"] for r in df.orderBy("pos").collect()]
    assert values(items) == model
    for s, e in [(0, 5), (-4, -1), (3, -3), (5, 2), (-300, 4)]:
        n = len(model)
        lo, hi = max(0, s + n if s < 0 else s), min(n - 1, e + n if e < 0 else e)
        assert values(L.lrange(items, s, e)) == (model[lo : hi + 1] if lo <= hi else []), (s, e)
    m = list(model)
    for _ in range(2):
        m.reverse()
        m.remove("a")
        m.reverse()
    assert values(L.lrem(items, -2, "a")) == m
    assert values(L.linsert(items, "b", "new")) == model[: model.index("b")] + ["new"] + model[model.index("b") :]
    where = [i for i, v in enumerate(model) if v == "c"]
    assert rows(L.lpos(items, "c", rank=-2, count=1)) == [("k", where[-2])]
    assert rows(L.lpos(items, "c", count=0)) == [("k", i) for i in where]
    popped, rest = L.lpop(items, 3, right=True)
    assert values(popped) == model[-3:] and values(rest) == model[:-3]
    assert values(L.lmove(items, "k", "k")) == [model[0], *model[1:]]
    assert values(L.lmove(items, "k", "k", put_right=True)) == [*model[1:], model[0]]


def test_bitmaps(spark):
    packed = spark.createDataFrame([("k", bytearray(b"\xff\xf0\x00"))], "key string, value binary")
    bits = B.unpack(packed)
    assert rows(bits) == [("k", i) for i in range(12)]
    assert rows(B.bitpos(bits, 0)) == [("k", 12)] and rows(B.bitpos(bits, 1)) == [("k", 0)]
    assert rows(B.bitcount(bits, 1, 1)) == [("k", 4)]
    one = lambda x: B.unpack(spark.createDataFrame([("k", bytearray([x]))], "key string, value binary")).select("bit")
    value = lambda df: sum(1 << (7 - r["bit"]) for r in df.collect())
    assert [value(B.bitop(op, [one(0x0F), one(0x33)])) for op in ("AND", "OR", "XOR", "DIFF")] == [0x03, 0x3F, 0x3C, 0x0C]
    assert value(B.bitop("NOT", [one(0x0F)])) == 0xF0
    log = spark.createDataFrame([("k", 3, 1, 1), ("k", 3, 0, 2), ("k", 5, 1, 3)], "key string, bit long, on int, seq long")
    assert rows(B.setbit(log)) == [("k", 5)]


def test_geo(spark):
    at = spark.createDataFrame([(13.361389, 38.115556)], "lon double, lat double")
    score = geo_score(F.col("lon"), F.col("lat"))
    assert tuple(at.select(score, geo_text(score)).first()) == (3476004292229755.0, "sqc8b49rny0")
    places = spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    z = G.geoadd(places)
    pair = spark.createDataFrame([("s", "Palermo", "Catania"), ("s", "Palermo", "none")], "key string, a string, b string")
    got = {r["b"]: r["dist"] for r in G.geodist(z, pair).collect()}
    assert abs(got["Catania"] - 166274.1516) < 1 and got["none"] is None
    found = lambda **k: {r["member"] for r in G.geosearch(z, 15.0, 37.0, unit="km", **k).collect()}
    assert found(radius=200) == {"Palermo", "Catania"} and found(radius=100) == {"Catania"}
    assert found(radius=200, count=1) == {"Catania"} and found(box=(400, 400)) == {"Palermo", "Catania"}
    with pytest.raises(Exception, match="invalid longitude"):
        G.geoadd(places.withColumn("lon", F.lit(181.0))).collect()


def test_vectors(spark):
    v = spark.createDataFrame([("k", "alpha", [1.0, 0.0, 0.0, 0.0]), ("k", "beta", [0.9, 0.1, 0.0, 0.0]), ("k", "far", [0.0, 0.0, 0.0, 1.0])], "key string, elem string, vec array<float>")
    got = vectors.vsim(v, [1.0, 0, 0, 0], 2).orderBy(F.desc("score")).collect()
    assert [r["elem"] for r in got] == ["alpha", "beta"] and abs(got[0]["score"] - 1) < 1e-9
    big = spark.createDataFrame([("k", "e", [3e38, 3e38])], "key string, elem string, vec array<float>")
    assert all(abs(x - 0.5**0.5) < 1e-6 for x in vectors.vemb(big).first()["vec"])
    assert vectors.vsim_elem(v, "none").count() == 0
    links = vectors.vlinks(v, v, 1).collect()
    assert {(r["query"], r["elem"]) for r in links} >= {("alpha", "beta"), ("beta", "alpha")}


def test_slots_hll_scripts(spark):
    keys = spark.createDataFrame([("7858tqv03y",), ("5yzd{6}hzw",), ("bxmcjzi3{}",), ("",)], "key string")
    assert [r[0] for r in keys.select(key_slot(F.col("key"))).collect()] == [773, 5781, 10246, 0]
    many = spark.range(20000).select(F.lit("k").alias("key"), F.col("id").alias("elem"))
    for n in (hll.pfcount(hll.pfadd(many)).first()["n"], hll.estimate(hll.registers(many)).first()["n"]):
        assert abs(n - 20000) < 0.025 * 20000
    reg = ScriptRegistry()
    source = "def run(keys, args):\n    return keys[0].str.upper() + args[0]"
    sha = reg.load(source)
    assert sha == hashlib.sha1(source.encode()).hexdigest() and reg.exists(sha, "x") == [True, False]
    assert keys.limit(1).select(reg.evaluate_sha(sha, [F.col("key")], [F.lit("!")])).first()[0] == "7858TQV03Y!"
    reg.flush()
    with pytest.raises(KeyError):
        reg.evaluate_sha(sha, [F.col("key")])


def test_hash_expiry(spark):
    h = spark.createDataFrame([("k", "p", "1", None), ("k", "v", "2", 5000)], "key string, field string, value string, expire_at long")
    code = lambda c, at=9000: {r["field"]: r["code"] for r in hashes.hexpire(h, F.lit(at), 1000, c).collect()}
    assert code("GT") == {"p": 0, "v": 1} and code("LT") == {"p": 1, "v": 0} and code("NX") == {"p": 1, "v": 0} and code("", 500) == {"p": 2, "v": 2}
    ask = spark.createDataFrame([("k", "p"), ("k", "v"), ("k", "x")], "key string, field string")
    assert rows(hashes.httl(h, ask, 1001)) == [("k", "p", -1), ("k", "v", 3), ("k", "x", -2)]
    texts = spark.createDataFrame([(3.0,), (2.5,), (-0.0,)], "x double").select(hashes.float_text(F.col("x"))).collect()
    assert [r[0] for r in texts] == ["3", "2.5", "0"]


def test_pubsub_and_queue(spark):
    exact = spark.createDataFrame([("s1", "news"), ("s1", "sport")], "session string, channel string")
    msgs = spark.createDataFrame([("news", "a"), ("other", "b")], "channel string, payload string")
    got = pubsub.fanout(msgs, exact, [("s1", "n*"), ("s2", "*")]).select("channel", "session").collect()
    assert sorted(map(tuple, got)) == [("news", "s1"), ("news", "s1"), ("news", "s2"), ("other", "s2")]
    req = spark.createDataFrame([("k", "r1", 10), ("k", "r2", 20)], "key string, req string, at long")
    arr = spark.createDataFrame([("k", "i1", 15)], "key string, item string, at long")
    assert sorted((r["req"], r["item"]) for r in blocking.blpop(req, arr, 0).collect()) == [("r1", "i1"), ("r2", None)]


def test_replay_and_transactions(spark):
    rng = random.Random(8)
    log, state = [], {}
    for seq in range(400):
        k, cmd = rng.choice("abcdef"), rng.choice(["SET", "APPEND", "INCRBY", "DEL", "SET"])
        arg = str(rng.randrange(10))
        if cmd == "SET":
            state[k] = arg
        elif cmd == "APPEND":
            state[k] = state.get(k, "") + arg
        elif cmd == "INCRBY":
            state[k] = str(int(state.get(k, "0")) + int(arg))
        else:
            state.pop(k, None)
        log.append((k, seq, cmd, [arg]))
    df = spark.createDataFrame(log, "key string, seq long, cmd string, args array<string>")
    assert dict(rows(replay.mixed(df))) == state
    kv = spark.createDataFrame([("a", "1"), ("b", "2")], "key string, value string")
    batch = spark.createDataFrame([("a", 1, "x"), ("c", 2, "y")], "key string, seq long, value string")
    seen = spark.createDataFrame([("a", 5)], "key string, version long")
    moved = spark.createDataFrame([("a", 6)], "key string, version long")
    assert rows(transactions.execute(kv, batch, watched=seen, current=seen)) == [("a", "x"), ("b", "2"), ("c", "y")]
    assert rows(transactions.execute(kv, batch, watched=seen, current=moved)) == [("a", "1"), ("b", "2")]


def test_range_index(spark, tmp_path):
    idx = spark.createDataFrame([(f"k{i}", str(i)) for i in range(6)], "k string, v string")
    path = str(tmp_path / "index")
    range_index.build(idx, path, 2)
    idx = spark.read.parquet(path)
    assert [r["k"] for r in range_index.riscan(idx, "k0", 3).collect()] == ["k0", "k1", "k2"]
    assert rows(range_index.rirange(idx, "k1", "k3")) == [("k1", "1"), ("k2", "2"), ("k3", "3")]
