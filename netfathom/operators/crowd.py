"""A k-anonymous crowd map from contribution records.

Records are (contributor, area, network, band, samples, observed_ms, rsrp, sinr, week) with histograms as maps from value to
weight. Every record is held suspect: fields that become keys must be short strings without a bar, counts are clamped, and
a histogram may not outweigh twice its samples (64 at least). Cells are published from ``k`` contributors and ``n`` samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import percentiles

# fixed values
MIN_CONTRIBUTORS, MIN_SAMPLES = 3, 30
MAX_COUNT, MAX_SAMPLES = 1_000_000_000, 5_000_000
CELL = ["area", "network", "band"]


def count_of(v: Column) -> Column:
    """A finite count of 0 or more, floored and clamped; else 0."""
    d = v.cast("double")
    return F.when(d.isNull() | F.isnan(d) | (d < 0) | (d == float("inf")), 0).otherwise(F.least(F.floor(F.least(d, F.lit(float(MAX_COUNT)))), F.lit(MAX_COUNT))).cast("long")


def _sane_key(c: Column, most: int) -> Column:
    return F.coalesce(c.rlike(rf"^[^|]{{1,{most}}}\z"), F.lit(False))  # names the column once, as it may be a long expression


def _hist_weight(h: Column) -> Column:
    return F.aggregate(F.map_values(h), F.lit(0).cast("long"), lambda a, w: a + count_of(w))


def is_sane_record() -> Column:
    samples = count_of(F.col("samples"))
    light = lambda h: F.col(h).isNull() | ((F.size(F.map_keys(h)) <= 512) & (_hist_weight(F.col(h)) <= F.greatest(samples * 2, F.lit(64))))
    week = F.col("week").isNull() | (F.length("week") <= 16)
    return _sane_key(F.col("area"), 24) & _sane_key(F.col("network"), 16) & _sane_key(F.col("band"), 16) & week & (samples <= MAX_SAMPLES) & light("rsrp") & light("sinr")


def crowd_aggregate(records: DataFrame, k: int = MIN_CONTRIBUTORS, n: int = MIN_SAMPLES) -> DataFrame:
    """Published cells: contributors, samples, observed_ms, weeks, and percentiles 10, 50, 90 of rsrp and sinr."""
    sane = records.where(is_sane_record())
    cells = sane.groupBy(*CELL).agg(F.countDistinct("contributor").alias("contributors"), F.sum(count_of(F.col("samples"))).alias("samples"), F.sum(count_of(F.col("observed_ms"))).alias("observed_ms"), F.array_sort(F.collect_set("week")).alias("weeks"))
    cells = cells.where((F.col("contributors") >= k) & (F.col("samples") >= n))
    # both histograms in one pass, as (cell, kind, value, weight)
    entries = lambda h: F.transform(F.coalesce(F.map_entries(h), F.array().cast("array<struct<key:double,value:double>>")), lambda e: F.struct(F.lit(h).alias("kind"), e["key"].alias("value"), e["value"].alias("w")))
    long = sane.select(*CELL, F.inline(F.concat(entries("rsrp"), entries("sinr")))).where("value is not null and not isnan(value)").groupBy(*CELL, "kind", "value").agg(F.sum(count_of(F.col("w"))).alias("weight"))
    p = percentiles(long, [*CELL, "kind"], "value", "B", p10=0.1, p50=0.5, p90=0.9)
    wide = p.groupBy(*CELL).agg(*[F.max(F.when(F.col("kind") == h, F.col(q))).alias(f"{h}_{q}") for h in ("rsrp", "sinr") for q in ("p10", "p50", "p90")])
    return cells.join(wide, CELL, "left")


def crowd_stats(records: DataFrame, k: int = MIN_CONTRIBUTORS, n: int = MIN_SAMPLES, by: list[str] | None = None) -> DataFrame:
    """One row: cells seen, withheld and published, and records dropped. With ``by`` (columns that a cell has one value of), a row
    for each of their values."""
    by = by or []
    flagged = records.withColumn("_sane", is_sane_record())
    # a group per cell, and one of the records that were dropped
    cells = flagged.groupBy(*by, *[F.when(F.col("_sane"), F.col(c)).alias(c) for c in CELL], "_sane").agg(F.countDistinct("contributor").alias("c"), F.sum(count_of(F.col("samples"))).alias("s"), F.count("*").alias("r"))
    enough = (F.col("c") >= k) & (F.col("s") >= n)
    sane = F.col("_sane")
    return cells.groupBy(*by).agg(F.count_if(sane).alias("cells_seen"), F.count_if(sane & ~enough).alias("cells_withheld"), F.count_if(sane & enough).alias("cells_published"), F.coalesce(F.sum(F.when(~sane, F.col("r"))), F.lit(0)).alias("records_dropped"))
