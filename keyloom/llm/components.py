"""Connected components by passing on the smallest label, with jumps from label to label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.scratch import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, label) for every id in ``edges`` (a, b): label is the smallest id reachable.

    Each pass moves every label to the smallest among its neighbours', then to that label's own
    label, so chains shorten by half; each is written to the shared folder. Aggregations combine
    before their shuffles and joins on a hub's id can be split, so a hub is no task's burden.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
    both = cut(both.distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        met = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("best"))
        jump = met.select(F.col("id").alias("best"), F.col("best").alias("beyond"))
        moved = cut(met.join(jump, "best", "left").select("id", "label", F.least("best", F.coalesce("beyond", "best")).alias("new")), "labels")
        labels = moved.select("id", F.col("new").alias("label"))
        if moved.where("new < label").isEmpty():
            return labels
