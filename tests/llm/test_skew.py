"""Hot keys: bounded in number, dealt to parts, and joins that give what plain joins give."""

import random

import pytest
from keyloom.llm import line_dedup, skew
from pyspark.sql import functions as F


@pytest.fixture
def frames(spark):
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 50).otherwise(F.col("id"))
    big = spark.range(3000).select(key.alias("key"), F.col("id").alias("v"))
    small = spark.range(60).select(F.col("id").alias("key"), (F.col("id") * 10).alias("w")).union(spark.createDataFrame([(7, 1), (None, 2)], "key long, w long"))
    counts = big.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return big, small, counts, skew.hot_keys(counts, ["key"], 20)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_few_hot_keys(frames):
    big, _, counts, hot = frames
    found = {r["key"]: r["_parts"] for r in hot.collect()}
    assert found == {7: 7} and all(n <= 3000 // 20 + 1 for k, n in counts.collect() if k not in found)
    assert skew.hot_keys(counts.limit(0), ["key"]).count() == 0


@pytest.mark.parametrize("how", ["inner", "left_semi", "left"])
def test_salted_join_equals_the_plain_one(frames, how):
    big, small, _, hot = frames
    got = skew.salted_join(big, small, ["key"], hot, by=["v"], how=how)
    assert got.columns == big.join(small, "key", how).columns and rows(got) == rows(big.join(small, "key", how))
    dealt = skew._dealt(big, ["key"], hot, ["v"]).groupBy("key", "_salt").count()
    assert max(r["count"] for r in dealt.collect()) < 2 * (3000 // 20)


def test_one_line_in_most_documents(spark, monkeypatch):
    monkeypatch.setattr(skew, "MAX_HOT", 3)
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice(["the very common line", f"a line of its own {i} {k}", "THE VERY COMMON LINE ", f"held by a few {rng.randrange(9)}"]) for k in range(6))) for i in range(200)]
    first = {}
    for i, t in docs:
        for s in t.split("\n"):
            first.setdefault(s.strip().lower(), i)
    got = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(i, "\n".join(s for s in t.split("\n") if first[s.strip().lower()] == i)) for i, t in docs]


def test_lines_of_long_texts_and_of_null_ids(spark):
    """With three documents as the least; a null id counts as one, after every other."""
    long_ = "shared by all of them\n" + "x" * 400_000 + "\n" + "\n".join(f"line number {k}" for k in range(20_000))
    rows_ = [(1, "shared by all of them\nheld by three"), (2, long_), (3, "held by three\nshared by all of them"), (None, "shared by all of them\nheld by three")]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows_, "doc_id long, text string"), min_docs=3).collect()}
    assert got[1] == (2, 0, rows_[0][1]) and got[2] == (20_002, 1, long_.split("\n", 1)[1])
    assert got[3] == (2, 2, "") and got[None] == (2, 2, "")
