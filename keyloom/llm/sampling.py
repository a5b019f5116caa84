"""Bounded samples of labelled rows in hash order."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: A table with more labels than this has no labels, but free text.
MAX_LABELS = 1000


def count_labels(rows: DataFrame) -> dict:
    """Rows of each ``label``."""
    got = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).limit(MAX_LABELS + 1).collect()
    if len(got) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels")
    return {r["label"]: r["n"] for r in got}


def _cutoff(share: float) -> int:
    """The largest 64-bit hash of a ``share`` of all hashes."""
    return min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))


def hash_sample(rows: DataFrame, per: int, counts: dict, attach: Callable[[DataFrame], DataFrame] = lambda near: near) -> dict[object, list[Row]]:
    """For each label the ``per`` rows of the least ``h``, in its order; one row for each h.

    rows: (label, h, ...), h a hash of the row's id; ``attach`` adds what the sample needs, such as
    texts, and may drop rows. Of rows with one h the smallest stays. Counts of the labels give a
    bound of the hash that twice ``per`` rows lie below, so about so many are read and none is
    ranked; where repeated ids or ``attach`` leave fewer, the bound is raised. The sample depends on
    the rows alone, not on how they are dealt to tasks.
    """
    share = {k: min(1.0, 2 * per / n) for k, n in counts.items() if n}
    out: dict[object, list[Row]] = {}
    while share:
        wanted = reduce(or_, [(F.col("label") == F.lit(k)) & (F.col("h") <= F.lit(_cutoff(s))) for k, s in share.items()])
        near = attach(rows.where(wanted))
        rest = [c for c in near.columns if c not in ("label", "h")]
        found: dict[object, list[Row]] = {k: [] for k in share}
        for r in near.groupBy("label", "h").agg(F.min(F.struct(*rest)).alias("row")).collect():  # about 2 * per of each label
            found[r["label"]].append(r)
        for k, own in found.items():
            if len(own) >= per or share[k] == 1.0:
                out[k] = [r["row"] for r in sorted(own, key=lambda r: r["h"])[:per]]
                del share[k]
            else:
                share[k] = min(1.0, 4 * share[k])
    return out


def agreed_labels(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of the ids whose rows all say 0 or all say 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(id_col)
    return known.agg(F.min(label_col).alias("_low"), F.max(label_col).alias("label")).where("_low = label").drop("_low")
