"""Window-spec helpers shared by operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F


def ordered(keys: list[str], *order) -> Window:
    """Rows of one key in order. Every keyed op passes ``keys`` so the
    window's exchange is hashpartitioning(keys), never a single partition."""
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return w.orderBy(*order)


def running(keys: list[str], *order) -> Window:
    return ordered(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(keys: list[str]) -> Window:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
