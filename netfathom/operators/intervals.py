"""Intervals from rows: clusters by gaps, states, sustained runs, and merged intervals. Ties go by the order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radio import enb
from .timeline import changes_only


def _islands(df: DataFrame, keys: list[str], order: list[str], fresh: Column) -> DataFrame:
    """Adds ``_island``: how many rows so far begin a new one."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_fresh", fresh.cast("int")).withColumn("_island", F.sum("_fresh").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_fresh")


def gap_cluster(df: DataFrame, keys: list[str], t: str, gap: int, order: list[str] | None = None, least: int = 1) -> DataFrame:
    """(keys, start_ms, end_ms, n): clusters that a gap of more than ``gap`` parts, of ``least`` rows or more."""
    order = [t, *(order or [])]
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))
    rows = _islands(df, keys, order, F.coalesce(F.col(t) - before > gap, F.lit(True)))
    return rows.groupBy(*keys, "_island").agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_island")


def state_intervals(df: DataFrame, keys: list[str], t: str, bad: Column, order: list[str]) -> DataFrame:
    """(keys, start_ms, end_ms, ongoing): runs of bad rows, each to the next good row, the last one to the last row."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_next", F.lead(t).over(by)).withColumn("_was", F.lag("_bad").over(by))
    rows = _islands(rows, keys, order, ~F.col("_bad").eqNullSafe(F.col("_was"))).where("_bad")
    out = rows.groupBy(*keys, "_island").agg(F.min(t).alias("start_ms"), F.max(t).alias("_last"), F.max_by("_next", F.struct(*order)).alias("_next"))
    return out.select(*keys, "start_ms", F.coalesce("_next", "_last").alias("end_ms"), F.col("_next").isNull().alias("ongoing"))


def sustained_runs(df: DataFrame, keys: list[str], t: str, bad: Column, order: list[str], least: int = 3, span: int = 15000) -> DataFrame:
    """(keys, start_ms, end_ms, n): runs of ``least`` bad rows or more that span ``span`` or more."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_was", F.lag("_bad").over(by))
    rows = _islands(rows, keys, order, ~F.col("_bad").eqNullSafe(F.col("_was"))).where("_bad")
    out = rows.groupBy(*keys, "_island").agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"), F.count("*").alias("n")).drop("_island")
    return out.where((F.col("n") >= least) & (F.col("end_ms") - F.col("start_ms") >= span))


def serving_changes(radio: DataFrame, keys: list[str], order: list[str], payload: list[str]) -> DataFrame:
    """Changes of the serving cell (rat, ci, mode) with ``before``, ``kind`` and ``poll_derived``. Rows whose payload is that of
    the row before are not fresh and don't count. The cell left is taken apart by its own technology; a change is derived
    from polls if the reading on either side of it was polled."""
    fresh = changes_only(radio, keys, payload, order).where("ci is not null")
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = fresh.withColumns({"before": F.lag("ci").over(by), "_rat": F.lag("rat").over(by), "_mode": F.lag("mode").over(by)}).where("before <> ci")
    old, new = enb(F.col("_rat"), F.col("before")), enb(F.col("rat"), F.col("ci"))
    kind = F.when(old.isNull() | new.isNull(), "undecomposable").when(old == new, "sector").otherwise("mast")
    return rows.withColumns({"kind": kind, "poll_derived": (F.col("mode") == "poll") | (F.col("_mode") == "poll")}).drop("_rat", "_mode")


def value_changes(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the previous known one, with it as ``before``; null values are passed over."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = df.where(F.col(value).isNotNull()).withColumn("before", F.lag(value).over(by))
    return rows.where(F.col("before").isNotNull() & (F.col("before") != F.col(value)))


def churn_clusters(changes: DataFrame, keys: list[str], t: str, value: str, gap: int = 120000, least: int = 4, order: list[str] | None = None) -> DataFrame:
    """(keys, start_ms, end_ms, n, n_distinct): clusters of changes in which a value comes back."""
    order = [t, *(order or [])]
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))
    rows = _islands(changes, keys, order, F.coalesce(F.col(t) - before > gap, F.lit(True)))
    out = rows.groupBy(*keys, "_island").agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms"), F.count("*").alias("n"), F.countDistinct(value).alias("n_distinct"))
    return out.where((F.col("n") >= least) & (F.col("n") > F.col("n_distinct"))).drop("_island")


def merge_intervals(df: DataFrame, keys: list[str], slack: int = 10000, observed: str | None = None) -> DataFrame:
    """(keys, start_ms, end_ms, n): intervals that touch within ``slack`` become one. With a column ``observed``, one that was
    observed makes the whole so."""
    more = [F.bool_or(observed).alias(observed)] if observed else []
    order = ["start_ms", "end_ms"]
    before = F.max("end_ms").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = _islands(df, keys, order, F.coalesce(F.col("start_ms") > before + slack, F.lit(True)))
    return rows.groupBy(*keys, "_island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"), *more).drop("_island")


def bucketed_range_join(points: DataFrame, windows: DataFrame, keys: list[str], t: str, lo: str, hi: str, bucket: int, how: str = "inner") -> DataFrame:
    """Windows with the points of the same keys in [lo, hi]: an equality join on time buckets, then the exact bounds. A
    window is copied to each bucket it meets; points are not copied."""
    p = points.withColumn("_b", F.floor(F.col(t) / bucket))
    w = windows.withColumn("_b", F.explode(F.sequence(F.floor(F.col(lo) / bucket), F.floor(F.col(hi) / bucket))))
    return w.join(p, [*keys, "_b"], how).where(F.col(t).between(F.col(lo), F.col(hi))).drop("_b")


def suppress_overlaps(degraded: DataFrame, outages: DataFrame, keys: list[str]) -> DataFrame:
    """The degraded intervals that overlap no outage of the same keys. One union and one window: in the order of starts, an
    interval overlaps an earlier outage if the latest end so far reaches its start, and a later one if the next start comes
    before its end."""
    both = degraded.withColumn("_o", F.lit(False)).unionByName(outages.select(*keys, "start_ms", "end_ms", F.lit(True).alias("_o")), allowMissingColumns=True)
    by = Window.partitionBy(*keys).orderBy("start_ms", ~F.col("_o"))
    reached = F.max(F.when(F.col("_o"), F.col("end_ms"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    down = Window.partitionBy(*keys).orderBy(F.desc("start_ms"), F.desc(~F.col("_o")))
    ahead = F.last(F.when(F.col("_o"), F.col("start_ms")), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    rows = both.withColumn("_reached", reached).withColumn("_ahead", ahead).where(~F.col("_o"))
    return rows.where((F.col("_reached").isNull() | (F.col("_reached") < F.col("start_ms"))) & (F.col("_ahead").isNull() | (F.col("_ahead") > F.col("end_ms")))).drop("_o", "_reached", "_ahead")


def local_count(df: DataFrame, keys: list[str], t: str, reach: int, name: str) -> DataFrame:
    """Adds how many rows of the same keys lie within ``reach`` of each, itself included."""
    return df.withColumn(name, F.count("*").over(Window.partitionBy(*keys).orderBy(t).rangeBetween(-reach, reach)))
