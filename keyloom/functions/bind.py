"""Intermediate results within an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x computed once, however often f uses it; expressions stay linear in size."""
    return F.get(F.transform(F.array(x), lambda v: f(v)), F.lit(0))
