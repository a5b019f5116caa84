"""The folder that driver and executors share, named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_STORED: dict[tuple, tuple[str, object]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset a session within one process gets a
    local folder; on a cluster, where executors would not see it, that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="keyloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], order: str) -> DataFrame:
    """The table that ``make`` gives for a source, written once in an application in ranges of ``order``
    and read as it is stored, so that scans skip files and row groups."""
    made = (spark.sparkContext.applicationId, source, name)
    if made not in _STORED:
        df, path = make(), f"{shared_dir(spark).rstrip('/')}/keyloom/{name}-{uuid.uuid4().hex}"
        df.repartitionByRange(order).sortWithinPartitions(order).write.parquet(path)
        _STORED[made] = path, df.schema
    path, schema = _STORED[made]
    return spark.read.schema(schema).parquet(path)
