"""Where tables for all executors go, and what is stored once."""

from types import SimpleNamespace

import pytest
from keyloom.sources import shared


def session(master, found=None):
    held = {"spark.checkpoint.dir": found} if found else {}
    return SimpleNamespace(conf=SimpleNamespace(get=held.get, set=held.__setitem__), sparkContext=SimpleNamespace(master=master)), held


def test_a_cluster_must_name_the_folder():
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://host:7077", "k8s://https://host"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared.shared_dir(session(master)[0])
        assert shared.shared_dir(session(master, "hdfs:///x")[0]) == "hdfs:///x"
    for master in ("local", "local[8]", "local[*]"):
        s, held = session(master)
        assert shared.shared_dir(s) == held["spark.checkpoint.dir"] == shared.shared_dir(s)


def test_a_table_is_stored_once_in_order(spark):
    made = []

    def make():
        made.append(1)
        return spark.range(100).selectExpr("99 - id AS k", "id AS v")

    for _ in range(2):
        got = shared.stored(spark, "here", "numbers", make, "k")
        assert sorted(map(tuple, got.collect())) == [(k, 99 - k) for k in range(100)]
    assert len(made) == 1
