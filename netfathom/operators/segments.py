"""Scans along a key's time that a key of any size shares among tasks.

A key's line is cut into segments of time. Inside a segment a window finds the last (or next) value; of each segment only its
last and first value are kept, these few are scanned along the key, and what was known when a segment began, or comes after it
ended, is joined to its rows. Each step is linear in its rows, and no task holds more than a segment of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_MS = 6 * 3600 * 1000


def segment(t: str, span_ms: int) -> Column:
    return F.floor(F.col(t) / span_ms).alias("_segment")


def along(rows: DataFrame, keys: list[str], t: str, order: list[str], last: dict[str, Column] | None = None, upcoming: dict[str, Column] | None = None, own: bool = True, span_ms: int = SEGMENT_MS) -> DataFrame:
    """Adds columns along the rows of a key in ``order``, which begins with the time ``t``.

    ``last``: the last non-null value of an expression up to the row (itself included if ``own``), ``upcoming``: the next one
    after it; null where there is none. Rows with equal ``order`` follow each other in any order. Rows with a null key or
    time take values from rows of the same kind only. An empty table gives no rows.
    """
    last, upcoming = last or {}, upcoming or {}
    names = rows.columns
    value = {out: f"_v{i}" for i, out in enumerate([*last, *upcoming])}
    # a struct, so that a key's value is told apart from none
    parts = rows.select("*", segment(t, span_ms), *(F.when(e.isNotNull(), F.struct(e.alias("v"))).alias(value[out]) for out, e in {**last, **upcoming}.items()))
    dealt = parts.repartition(*keys, "_segment")
    up = Window.partitionBy(*keys, "_segment").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    down = Window.partitionBy(*keys, "_segment").orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt
    for out in last:
        found = found.withColumn(f"_near{value[out]}", F.last(value[out], ignorenulls=True).over(up))
    for out in upcoming:
        found = found.withColumn(f"_near{value[out]}", F.last(value[out], ignorenulls=True).over(down))
    place = {out: F.when(F.col(value[out]).isNotNull(), F.struct(*order)) for out in value}
    ends = parts.where("_segment is not null").groupBy(*keys, "_segment").agg(*(F.max_by(value[out], place[out]).alias(value[out]) for out in last), *(F.min_by(value[out], place[out]).alias(value[out]) for out in upcoming))
    before = Window.partitionBy(*keys).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.desc("_segment")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, "_segment", *(F.last(value[out], ignorenulls=True).over(before if out in last else after).alias(f"_far{value[out]}") for out in value))
    return found.join(carried, [*keys, "_segment"], "left").select(*names, *(F.coalesce(f"_near{value[out]}", f"_far{value[out]}")["v"].alias(out) for out in value))
