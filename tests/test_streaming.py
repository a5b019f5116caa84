import json

from keyloom.operators import pubsub as batch
from keyloom.streaming.expiry import running_counts
from keyloom.streaming.pubsub import deliveries
from keyloom.streaming.queue import blocking_pops
from pyspark.sql import functions as F


def write(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_deliveries_equal_the_batch(spark, tmp_path):
    rows = [{"channel": c, "payload": str(i)} for i, c in enumerate(["news", "sport", "nature", "none"] * 3)]
    write(tmp_path / "m", "a", rows)
    exact, patterns = spark.createDataFrame([("s1", "news"), ("s2", "sport")], "session string, channel string"), [("s1", "n*"), ("s3", "*")]
    schema = "channel string, payload string"
    got = run(deliveries(spark.readStream.schema(schema).json(str(tmp_path / "m")), exact, patterns), "deliveries")
    want = batch.fanout(spark.read.schema(schema).json(str(tmp_path / "m")), exact, patterns)
    key = lambda df: sorted((r["channel"], r["payload"], r["session"], r["pattern"] or "") for r in df.collect())
    assert key(got) == key(want) and len(key(got)) == 27


def test_blocking_pops_meet_in_order(spark, tmp_path):
    write(tmp_path / "q", "a", [{"key": "k", "kind": "pop", "id": "r1", "at": 1}, {"key": "k", "kind": "push", "id": "i1", "at": 2}, {"key": "k", "kind": "push", "id": "i2", "at": 3}, {"key": "x", "kind": "pop", "id": "r9", "at": 1}])
    events = spark.readStream.schema("key string, kind string, id string, at long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "q"))
    q = blocking_pops(events).writeStream.format("memory").queryName("pops").outputMode("append").start()
    q.processAllAvailable()
    write(tmp_path / "q", "b", [{"key": "k", "kind": "pop", "id": "r2", "at": 4}])
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("pops").collect())) == [("k", "r1", "i1"), ("k", "r2", "i2")]


def test_windows_with_late_rows(spark, tmp_path):
    write(tmp_path / "w", "a", [{"key": "k", "ts": "2024-01-01T00:10:00"}, {"key": "k", "ts": "2024-01-01T00:50:00"}, {"key": "k", "ts": "2024-01-01T03:00:00"}])
    events = spark.readStream.schema("key string, ts timestamp").json(str(tmp_path / "w"))
    got = run(running_counts(events), "counts").select(F.hour("window.start").alias("h"), "n").collect()
    assert [tuple(r) for r in got] == [(0, 2)]
