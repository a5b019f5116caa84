"""Rules of single commands, from the commands' own definitions."""

import math
import random

import pytest
from keyloom.functions.geo import covering_ranges, distance, geo_position, geo_score
from keyloom.operators import bitmaps as B
from keyloom.operators import blocking, hll, range_index, vectors
from keyloom.operators import geo as G
from keyloom.operators import hashes as H
from keyloom.operators import keyspace as K
from keyloom.operators import lists as L
from keyloom.operators import sets as S
from keyloom.operators import strings as T
from keyloom.operators import zsets as Z
from keyloom.plans import replay, transactions
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_expired_keys_stay_gone(spark):
    df = spark.createDataFrame([("p", None), ("v", 5000), ("old", 10)], "key string, expire_at long")
    assert rows(K.expire(df, F.lit(9000), 1000)) == [("p", 9000), ("v", 9000)]
    assert rows(K.expire(df, F.lit(9000), 1000, "GT")) == [("p", None), ("v", 9000)]
    assert rows(K.persist(df, df.select("key"), 1000)) == [("p", None), ("v", None)]
    ask = spark.createDataFrame([(k, 9000) for k in ("p", "v", "old", "none")], "key string, new_at long")
    assert dict(rows(K.expire_replies(df, ask, 1000))) == {"p": 1, "v": 1, "old": 0, "none": 0}
    assert dict(rows(K.expire_replies(df, ask, 1000, "GT"))) == {"p": 0, "v": 1, "old": 0, "none": 0}
    h = spark.createDataFrame([("k", "p", None), ("k", "v", 5000), ("k", "old", 10)], "key string, field string, expire_at long")
    assert rows(H.hexpire(h, F.lit(9000), 1000)) == [("k", "old", -2, None), ("k", "p", 1, 9000), ("k", "v", 1, 9000)]
    assert rows(H.hexpire(h, F.lit(900), 1000, "XX")) == [("k", "old", -2, None), ("k", "p", 0, None), ("k", "v", 2, None)]


def test_rename(spark):
    s = spark.createDataFrame([("a'\\", "1"), ("b", "2")], "key string, member string")
    assert rows(K.rename(s, "b", "b")) == rows(s) and rows(K.rename(s, "none", "b")) == rows(s)
    assert rows(K.rename(s, "b", "a'\\")) == [("a'\\", "2")] and rows(K.rename(s, "b", "a'\\", nx=True)) == rows(s)
    assert rows(K.rename(s, "b", "c", nx=True)) == [("a'\\", "1"), ("c", "2")]
    reply = lambda *a, **k: K.rename_reply(s, *a, **k).first()["reply"]
    assert [reply("b", "c"), reply("b", "a'\\", nx=True), reply("b", "c", nx=True), reply("none", "b"), reply("none", "b", nx=True)] == [1, 0, 1, None, None]
    with pytest.raises(Exception, match="WRONGTYPE"):
        K.wrong_type(s.select("key"), spark.createDataFrame([("b", "list")], "key string, type string"), "set").collect()
    assert K.wrong_type(s.select("key"), spark.createDataFrame([("b", "set")], "key string, type string"), "set").count() == 2


def test_set_options(spark):
    kv = spark.createDataFrame([("a", "1", None), ("b", "2", 5000), ("old", "3", 10)], "key string, value string, expire_at long")
    log = spark.createDataFrame([(k, 1, "x", 7) for k in ("a", "b", "old", "new")] + [("a", 2, "y", None)], "key string, seq long, value string, ttl long")
    px = T.deadlines(log, 1000, "PX")
    reply, after = T.set_with(kv, px, 1000)
    assert rows(reply) == [("a", "1"), ("b", "2"), ("new", None), ("old", None)]
    assert rows(after) == [("a", "y", None), ("b", "x", 1007), ("new", "x", 1007), ("old", "x", 1007)]
    assert rows(T.set_with(kv, px, 1000, mode="NX")[1]) == [("a", "1", None), ("b", "2", 5000), ("new", "x", 1007), ("old", "x", 1007)]
    assert rows(T.set_with(kv, px, 1000, mode="XX", keepttl=True)[1]) == [("a", "y", None), ("b", "x", 5000)]
    assert rows(T.set_with(kv, T.deadlines(log, 1000, "PXAT"), 1000)[1]) == [("a", "y", None)]
    assert rows(T.deadlines(log.where("seq = 2").withColumn("ttl", F.lit(-3)), 1000, "EXAT").select("expire_at")) == [(0,)]
    with pytest.raises(ValueError, match="syntax"):
        T.set_with(kv, px, 1000, mode="NXXX")
    with pytest.raises(Exception, match="invalid expire time"):
        T.deadlines(log.withColumn("ttl", F.lit(0)), 1000, "EX").collect()
    with pytest.raises(Exception, match="NaN or Infinity"):
        T.incrbyfloat_running(spark.createDataFrame([("c", 1, 1e308), ("c", 2, 1e308)], "key string, seq long, delta double")).collect()


def test_databases_and_scan(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (1, 0, "b")], "ns int, db int, key string")
    assert rows(K.select_db(df, 1)) == [(0, 1, "a")] and rows(K.flushdb(df, 0)) == [(0, 1, "a"), (1, 0, "b")]
    assert rows(K.flushall(df)) == [(1, 0, "b")] and rows(K.swapdb(df, 0, 1)) == [(0, 0, "a"), (0, 1, "a"), (1, 0, "b")]
    keys = spark.createDataFrame([(f"k{i:02}",) for i in range(30)] + [("k03",)], "key string")
    pages = [[r["key"] for r in K.scan(keys, c, pattern="*[02468]", count=12).collect()] for c in (0, 12, 24)]
    assert sorted(sum(pages, [])) == [f"k{i:02}" for i in range(0, 30, 2)] and len(pages[0]) == 6


def test_hash_floats_and_lengths(spark):
    h = spark.createDataFrame([("k", "a", "10.5", 5000), ("k", "old", "7", 10)], "key string, field string, value string, expire_at long")
    log = spark.createDataFrame([("k", "a", 0.5), ("k", "old", 1.25), ("k", "new", -2.0)], "key string, field string, delta double")
    assert rows(H.hincrbyfloat(log, h, 1000)) == [("k", "a", "11", 5000), ("k", "new", "-2", None), ("k", "old", "1.25", None)]
    with pytest.raises(Exception, match="NaN or Infinity"):
        H.hincrbyfloat(log.withColumn("delta", F.lit(math.inf))).collect()
    ask = spark.createDataFrame([("k", "a"), ("k", "x")], "key string, field string")
    assert rows(H.hstrlen(h, ask)) == [("k", "a", 4), ("k", "x", 0)]


def test_zadd_option_mixes(spark):
    z = spark.createDataFrame([("k", "a", 5.0)], "key string, member string, score double")
    log = spark.createDataFrame([("k", "a", -3.0, 1), ("k", "a", 2.0, 2), ("k", "b", -1.0, 3), ("k", "b", 4.0, 4), ("k", "b", -2.0, 5)], "key string, member string, score double, seq long")
    run = lambda **how: rows(Z.zadd(z, log, incr=True, **how))
    assert run(compare="GT") == [("k", "a", 7.0), ("k", "b", 3.0)] and run(compare="LT") == [("k", "a", 2.0), ("k", "b", -3.0)]
    assert run(mode="NX") == [("k", "a", 5.0), ("k", "b", -1.0)] and run(mode="XX", compare="GT") == [("k", "a", 7.0)]
    for bad in ({"mode": "NX", "compare": "GT"}, {"compare": "EQ"}, {"mode": "YY"}):
        with pytest.raises(ValueError):
            Z.zadd(z, log, **bad)
    with pytest.raises(Exception, match="not a number"):
        Z.zadd(z.withColumn("score", F.lit(math.inf)), log.withColumn("score", F.lit(-math.inf)), incr=True).collect()
    after = Z.zadd(z, log.where("seq > 1 AND seq < 4"))
    assert rows(Z.zadd_replies(z, after)) == [("k", 1)] and rows(Z.zadd_replies(z, after, changed=True)) == [("k", 2)]
    same = Z.zadd(z, log.where("seq = 2").withColumn("score", F.lit(5.0)))
    assert rows(Z.zadd_replies(z, same, changed=True)) == [("k", 0)]


def test_refused_bounds_and_places(spark):
    z = spark.createDataFrame([("k", m, 0.0) for m in "abc"], "key string, member string, score double")
    for low, high in (("a", "+"), ("-", "c"), ("", "+"), ("-", "")):
        with pytest.raises(ValueError, match="not valid string range item"):
            Z.zrangebylex(z, low, high)
    assert [r.member for r in Z.zrangebylex(z, "[", "(c").orderBy("member").collect()] == ["a", "b"]
    kept = Z.zrangestore(Z.zrangebylex(z, "(a", "+").withColumn("score", F.lit(3.0)), "d", z, by_lex=True)
    assert rows(kept.where("key = 'd'")) == [("d", "b", 0.0), ("d", "c", 0.0)] and kept.count() == 5
    assert rows(Z.zrange(z, 0, -1, limit=(1, 1))) == [("k", "b", 0.0)]
    items = spark.createDataFrame([("k", 0, "a"), ("k", 1, "b"), ("m", 0, "c")], "key string, pos long, value string")
    assert rows(L.lset(items, -1, "z")) == [("k", 0, "a"), ("k", 1, "z"), ("m", 0, "z")]
    for index in (1, -2):
        with pytest.raises(Exception, match="index out of range"):
            L.lset(items, index, "z").collect()
    with pytest.raises(ValueError, match="RANK"):
        L.lpos(items, "a", rank=0)


def test_draws_with_repeats(spark):
    s = spark.createDataFrame([("x", m) for m in "abc"] + [("y", "d")], "key string, member string")
    for got in (S.srandmember(s, -20, seed=1), H.hrandfield(s.withColumnRenamed("member", "field"), -20, seed=1)):
        found = rows(got)
        assert len(found) == 40 and {k for k, _ in found} == {"x", "y"} and len({m for k, m in found if k == "x"}) > 1


def test_bitmaps_with_lengths(spark):
    packed = spark.createDataFrame([("k", bytearray(b"\xff\xf0\x00")), ("z", bytearray(b"\x00\x00"))], "key string, value binary")
    bits, sizes = B.unpack(packed), B.packed_sizes(packed)
    assert rows(B.bytes_of(bits, sizes)) == [("k", 3), ("z", 2)]
    one, n = bits.where("key = 'k'").select("bit"), sizes.where("key = 'k'").select("n_bytes")
    assert rows(B.bitop("NOT", [one], n)) == [(i,) for i in range(12, 24)] and rows(B.bitop("NOT", [one])) == [(i,) for i in range(12, 16)]
    zero = sizes.where("key = 'z'").select("n_bytes")
    assert len(rows(B.bitop("NOT", [bits.where("key = 'z'").select("bit")], zero))) == 16
    assert rows(B.bitpos(bits, 0, sizes=sizes)) == [("k", 12), ("z", 0)] and rows(B.bitpos(bits, 1, sizes=sizes)) == [("k", 0), ("z", -1)]
    assert rows(B.bitpos(bits, 0, 0, 0, sizes=sizes)) == [("k", -1), ("z", 0)]
    assert rows(B.bitpos(bits, 1, 2, 7, unit="BIT", sizes=sizes)) == [("k", 2), ("z", -1)]
    assert rows(B.bitcount(bits, -2, -1, sizes=sizes)) == [("k", 4)] and rows(B.bitcount(bits, -1, -1, sizes=sizes)) == []
    log = spark.createDataFrame([("k", 3, 1, 1), ("k", 3, 0, 2), ("k", 90, 0, 3), ("k", 0, 0, 4)], "key string, bit long, on int, seq long")
    assert rows(B.setbit_replies(log, bits).select("seq", "old")) == [(1, 1), (2, 1), (3, 0), (4, 1)]
    assert rows(B.bytes_written(log, sizes)) == [("k", 12), ("z", 2)]


def test_bitpos_and_bitcount_against_plain_bits(spark):
    rng = random.Random(5)
    raw = {f"k{i}": bytes(rng.choice([0, 0, 255, 240, 15]) for _ in range(rng.randrange(1, 5))) for i in range(12)}
    packed = spark.createDataFrame([(k, bytearray(v)) for k, v in raw.items()], "key string, value binary")
    bits, sizes = B.unpack(packed).cache(), B.packed_sizes(packed)
    for start, end, unit in [(0, None, "BYTE"), (1, None, "BYTE"), (-2, -1, "BYTE"), (0, 1, "BYTE"), (2, 1, "BYTE"), (-20, 13, "BIT"), (3, -4, "BIT"), (9, 40, "BIT")]:
        for value in (0, 1):
            want, ones = {}, {}
            for k, v in raw.items():
                flags = [v[i // 8] >> (7 - i % 8) & 1 for i in range(8 * len(v))]
                n = len(v) if unit == "BYTE" else len(flags)
                lo = max(0, start + n) if start < 0 else start
                hi = min(n - 1, (end if end is not None else -1) + n if (end if end is not None else -1) < 0 else end)
                width = 8 if unit == "BYTE" else 1
                span = range(lo * width, (hi + 1) * width)
                ones[k] = sum(flags[i] for i in span)
                want[k] = next((i for i in span if flags[i] == value), len(flags) if value == 0 and end is None and lo <= hi else -1)
            assert dict(rows(B.bitpos(bits, value, start, end, unit=unit, sizes=sizes))) == want, (start, end, unit, value)
        counted = dict(rows(B.bitcount(bits, start, -1 if end is None else end, unit=unit, sizes=sizes)))
        assert counted == {k: n for k, n in ones.items() if n}, (start, end, unit)


def test_blpop_with_timeouts(spark):
    req = spark.createDataFrame([("k", "r1", 0), ("k", "r2", 50)], "key string, req string, at long")
    arr = spark.createDataFrame([("k", "i1", 60)], "key string, item string, at long")
    assert rows(blocking.blpop(req, arr, 20)) == [("k", "r1", None, None), ("k", "r2", "i1", 10)]
    rng = random.Random(6)
    events = [(t // 2, rng.choice("ab"), rng.choice(["item", "req"]), t) for t in range(300)]
    for timeout in (0, 3, 15):
        want, have, wait = {}, {"a": [], "b": []}, {"a": [], "b": []}
        for at, k, kind, n in sorted(events, key=lambda e: (e[0], e[2], e[3])):
            wait[k] = [w for w in wait[k] if not timeout or at <= w[1] + timeout]
            if kind == "req":
                want[n] = (k, n, have[k].pop(0), 0) if have[k] else (k, n, None, None)
                if want[n][2] is None:
                    wait[k].append((n, at))
            elif wait[k]:
                w, asked = wait[k].pop(0)
                want[w] = (k, w, n, at - asked)
            else:
                have[k].append(n)
        df = spark.createDataFrame(events, "at long, key string, kind string, n long")
        got = blocking.blpop(df.where("kind = 'req'").withColumnRenamed("n", "req"), df.where("kind = 'item'").withColumnRenamed("n", "item"), timeout)
        assert rows(got) == sorted(want.values(), key=repr)


def test_sketch_estimates_have_no_jump(spark):
    for n in (0, 1, 10, 500, 30_000, 45_000, 60_000, 200_000):
        regs = hll.registers(spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("elem")))
        got = hll.estimate(regs).collect()
        assert abs((got[0]["n"] if got else 0) - n) <= 0.025 * n + (n < 100) * 0.5
    full = spark.range(1 << 14).select(F.lit("k").alias("key"), F.col("id").alias("idx"), F.lit(51).alias("rank"))
    assert hll.estimate(full).count() == 1
    some = spark.range(50).select(F.lit("k").alias("key"), F.col("id").alias("elem"))
    more = spark.range(40, 60).select(F.lit("k").alias("key"), F.col("id").alias("elem"))
    assert rows(hll.changed(hll.registers(some), some)) == [("k", 0)] and rows(hll.changed(hll.registers(some), more)) == [("k", 1)]


def test_places_near_poles_and_the_date_line(spark, tmp_path):
    rng = random.Random(7)
    places = [(f"m{i}", rng.uniform(-180, 180), rng.choice([rng.uniform(-90, 90), rng.uniform(85, 90), rng.uniform(-3, 3)])) for i in range(2000)]
    df = spark.createDataFrame(places, "member string, lon double, lat double").withColumn("key", F.lit("k"))
    G.geoadd(df).write.parquet(str(tmp_path / "z"))
    z = spark.read.parquet(str(tmp_path / "z"))
    lon, lat = geo_position(F.col("score"))
    at = z.withColumns({"lon": lon, "lat": lat})
    for x, y in ((0.0, 0.0), (179.5, 1.0), (-179.9, -2.0), (20.0, 88.9), (10.0, -60.0)):
        for km in (50, 900, 4000, 11_000):
            d = distance(F.lit(x), F.lit(y), F.col("lon"), F.col("lat"), "km")
            want = {r["member"] for r in at.where(d <= km).select("member").collect()}
            assert {r["member"] for r in G.geosearch(z, x, y, radius=km, unit="km").select("member").collect()} == want
            across = distance(F.lit(x), F.col("lat"), F.col("lon"), F.col("lat"), "km") <= km
            up = distance(F.lit(x), F.lit(y), F.lit(x), F.col("lat"), "km") <= km / 2
            want = {r["member"] for r in at.where(across & up).select("member").collect()}
            assert {r["member"] for r in G.geosearch(z, x, y, box=(2 * km, km), unit="km").select("member").collect()} == want, (x, y, km)
    assert covering_ranges(0, 0, 180, 90) == [(0, (1 << 52) - 1)] and len(covering_ranges(10, 20, 1, 1)) <= 32
    plan = G.geosearch(z, 10.0, 20.0, radius=100, unit="km")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan and "score" in plan.split("PushedFilters")[1].split("]")[0] and "transform" not in plan


def test_scores_of_every_cell_bit(spark):
    at = spark.createDataFrame([(13.361389, 38.115556), (-180.0, -90.0), (180.0, 90.0), (0.0, 0.0)], "lon double, lat double")
    got = [r[0] for r in at.select(geo_score(F.col("lon"), F.col("lat"))).collect()]
    assert got == [3476004292229755.0, 0.0, float((1 << 52) - 1), float(0b11 << 50)]


def test_range_index_is_pushed_down(spark, tmp_path):
    index = range_index.build(spark.range(5000).select(F.format_string("%06d", "id").alias("k"), F.col("id").alias("v")), str(tmp_path / "i"))
    plan = range_index.rirange(index, "000100", "000200")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(k,000100)" in plan and "LessThanOrEqual(k,000200)" in plan and range_index.rirange(index, "000100", "000200").count() == 101
    m = range_index.rimetrics(index).first()
    assert (m["n"], m["k_bytes"], m["first"], m["last"]) == (5000, 30_000, "000000", "004999")
    named = spark.createDataFrame([("a", "x"), ("a", "y")], "idx string, k string")
    assert rows(range_index.riexists(named, spark.createDataFrame([("a",), ("b",)], "idx string"))) == [("a", 1), ("b", 0)]


def test_nearest_links_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    vecs = [(i, [rng.choice([0.0, 1.0, rng.gauss(0, 1)]) for _ in range(5)]) for i in range(150)] + [(150, [0.0] * 5), (151, [1.0] * 5), (152, [2.0] * 5)]
    unit = {i: [x / (math.hypot(*v) or 1) for x in v] for i, v in vecs}
    v = spark.createDataFrame([("k", i, x) for i, x in vecs], "key string, elem long, vec array<double>")
    queries = v.where("elem % 10 = 0 OR elem > 149")
    want = []
    for q in [i for i, _ in vecs if i % 10 == 0 or i > 149]:
        near = sorted((-round(sum(a * b for a, b in zip(unit[q], unit[i], strict=True)), 9), i) for i, _ in vecs if i != q)
        want += [(q, i, -s, k + 1) for k, (s, i) in enumerate(near[:4])]
    for block_rows, block_queries, stride in ((10**6, 10**6, 1024), (20, 6, 2), (1, 1, 1)):
        for name, x in (("BLOCK_ROWS", block_rows), ("BLOCK_QUERIES", block_queries), ("STRIDE", stride)):
            monkeypatch.setattr(vectors, name, x)
        if block_rows == 1:
            some = queries.limit(2)
            assert vectors.vlinks(v.where("elem < 6"), some, 3).count() == 2 * 3
            continue
        got = [(r["query"], r["elem"], round(r["score"], 9), r["rank"]) for r in vectors.vlinks(v, queries, 4).collect()]
        assert [(a, round(s, 6), k) for a, _, s, k in sorted(got)] == [(a, round(s, 6), k) for a, _, s, k in sorted(want)]
    assert vectors.vlinks(v, queries.limit(0), 3).count() == 0 == vectors.vlinks(v.limit(0), queries, 3).count()


def test_vector_attributes(spark):
    v = spark.createDataFrame([("k", "a", [1.0]), ("k", "b", [1.0])], "key string, elem string, vec array<double>")
    attrs = spark.createDataFrame([("k", "b", "old")], "key string, elem string, attr string")
    log = spark.createDataFrame([("k", "a", "x", 1), ("k", "a", "y", 2), ("k", "b", "", 3), ("k", "none", "z", 4)], "key string, elem string, attr string, seq long")
    assert rows(vectors.vsetattr(attrs, log, v)) == [("k", "a", "y")]
    assert rows(vectors.vismember(v, spark.createDataFrame([("k", "a"), ("k", "c")], "key string, elem string"))) == [("k", "a", 1), ("k", "c", 0)]
    assert rows(vectors.vinfo(v)) == [("k", "f32", 1, 2)]


def test_replay_of_every_structure(spark):
    rng = random.Random(9)
    log, hashes, sets, index, scores, texts = [], {}, {}, {}, {}, {}
    for seq in range(600):
        key, f, x = rng.choice("ab"), rng.choice("xyz"), float(rng.randrange(-5, 9))
        cmd = rng.choice(["HSET", "HDEL", "SADD", "SREM", "RI.SET", "RI.DEL", "ZADD", "ZINCRBY", "ZREM", "ZINCRBY", "SET", "MSET"]) if rng.random() > 0.02 else "DEL"
        args = {"HSET": [f, str(seq)], "RI.SET": [f, str(seq)], "ZADD": [str(x), f], "ZINCRBY": [str(x), f], "SET": [str(seq)], "MSET": [key, str(seq), "m", str(seq)], "DEL": []}.get(cmd, [f])
        log.append((key, seq, cmd, args))
        if cmd == "DEL":
            for d in (hashes, sets, index, scores):
                for k in [k for k in d if k[0] == key]:
                    del d[k]
            texts.pop(key, None)
        elif cmd in ("HDEL", "SREM", "RI.DEL", "ZREM"):
            {"HDEL": hashes, "SREM": sets, "RI.DEL": index, "ZREM": scores}[cmd].pop((key, f), None)
        elif cmd == "ZINCRBY":
            scores[key, f] = scores.get((key, f), 0.0) + x
        elif cmd == "ZADD":
            scores[key, f] = x
        elif cmd in ("SET", "MSET"):
            texts[key] = str(seq)
            if cmd == "MSET":
                texts["m"] = str(seq)
        else:
            {"HSET": hashes, "SADD": sets, "RI.SET": index}[cmd][key, f] = str(seq)
    df = spark.createDataFrame(log, "key string, seq long, cmd string, args array<string>")
    assert rows(replay.hashes(df)) == sorted((*k, v) for k, v in hashes.items()) and rows(replay.sets(df)) == sorted(sets)
    assert rows(replay.range_indexes(df)) == sorted((*k, v) for k, v in index.items())
    assert rows(replay.zsets(df)) == sorted((*k, v) for k, v in scores.items())
    assert dict(rows(replay.strings(df))) == texts


def test_batches_of_any_commands(spark):
    kv = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "key string, value string")
    batch = spark.createDataFrame([("a", 1, "INCRBY", ["5"]), ("b", 2, "DEL", []), ("a", 3, "APPEND", ["!"]), ("d", 4, "SET", ["x"])], "key string, seq long, cmd string, args array<string>")
    seen = spark.createDataFrame([("a", 5)], "key string, version long")
    moved = spark.createDataFrame([("a", 6)], "key string, version long")
    assert rows(transactions.execute_commands(kv, batch, watched=seen, current=seen)) == [("a", "6!"), ("c", "3"), ("d", "x")]
    assert rows(transactions.execute_commands(kv, batch, watched=seen, current=moved)) == rows(kv)
    assert rows(transactions.execute_commands(kv, batch)) == [("a", "6!"), ("c", "3"), ("d", "x")]
