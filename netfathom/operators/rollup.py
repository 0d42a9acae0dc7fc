"""Hourly and daily roll-ups with lossless histograms.

A bucket holds counts, a mask of the minutes it saw, and count histograms kept as long rows beside it. Buckets of the same
key add up (masks are united), so partial buckets may be merged in any order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOUR_MS, DAY_MS, MINUTE_MS = 3600000, 86400000, 60000


def hour_of(t: str) -> Column:
    return (F.col(t) - F.pmod(F.col(t), F.lit(HOUR_MS))).cast("long")


def minute_bit(t: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod({t}, {HOUR_MS}) div {MINUTE_MS} as int))")


def compact_hour(df: DataFrame, keys: list[str], t: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """(hour, keys, n, mask, minutes, first_ms, last_ms, sums) of rows."""
    rows = df.withColumn("hour", hour_of(t)).withColumn("_bit", minute_bit(t))
    out = rows.groupBy("hour", *keys).agg(F.count("*").alias("n"), F.bit_or("_bit").alias("mask"), F.min(t).alias("first_ms"), F.max(t).alias("last_ms"), *[F.sum(c).alias(k) for k, c in (sums or {}).items()])
    return out.withColumn("minutes", F.bit_count("mask"))


def tally(df: DataFrame, keys: list[str], t: str, value: str) -> DataFrame:
    """(hour, keys, value, n): how often each value occurs per bucket, beside it; tallies of a bucket add up."""
    return df.where(F.col(value).isNotNull()).groupBy(hour_of(t).alias("hour"), *keys, value).agg(F.count("*").alias("n"))


def bit_counts(df: DataFrame, keys: list[str], flags: str, bits: int) -> DataFrame:
    """(keys, bit, n): how many rows have each bit of a mask set; a sum for each bit, so rows are not copied."""
    sums = df.groupBy(*keys).agg(*[F.sum(F.expr(f"cast(shiftright({flags}, {k}) & 1 as bigint)")).alias(f"_{k}") for k in range(bits)])
    return sums.select(*keys, F.inline(F.array(*[F.struct(F.lit(k).alias("bit"), F.col(f"_{k}").alias("n")) for k in range(bits)]))).where("n > 0")


def bucket_stats(buckets: DataFrame, hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds success_rate and the p50 and p90 of a histogram (hour, keys, value, n) to buckets; null where nothing was tried."""
    from ..functions.stats import percentiles

    own = ["hour", *keys]
    pct = percentiles(hist.withColumnRenamed("n", "weight"), own, value, "C", p50_ms=0.5, p90_ms=0.9)
    return buckets.join(pct, own, "left").withColumn("success_rate", F.try_divide(F.col("ok_n").cast("double"), F.col("n")))


def compact_once(state: DataFrame | None, rows: DataFrame, keys: list[str], t: str) -> DataFrame:
    """(hour, keys, n, mask, first_ms, last_ms, minutes, mark): hourly buckets with rows (id) added that lie behind the buckets'
    mark, the greatest id consumed; what is delivered again adds nothing."""
    if state is not None:
        last = state.agg(F.max("mark").alias("_mark"))
        rows = rows.crossJoin(F.broadcast(last)).where(F.coalesce(F.col("id") > F.col("_mark"), F.lit(True))).drop("_mark")  # one row joined on
    fresh = compact_hour(rows, keys, t).join(rows.groupBy(hour_of(t).alias("hour"), *keys).agg(F.max("id").alias("mark")), ["hour", *keys])
    both = fresh if state is None else state.unionByName(fresh)
    out = both.groupBy("hour", *keys).agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), F.max("mark").alias("mark"))
    return out.withColumn("minutes", F.bit_count("mask"))


def merge_buckets(buckets: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Buckets of the same hour and keys as one."""
    out = buckets.groupBy("hour", *keys).agg(F.sum("n").alias("n"), F.bit_or("mask").alias("mask"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"), *[F.sum(c).alias(c) for c in sums])
    return out.withColumn("minutes", F.bit_count("mask"))


def roll_day(hourly: DataFrame, keys: list[str], dropped: list[str], sums: list[str], done: DataFrame | None = None) -> DataFrame:
    """(day, keys, n, buckets, hours, cells): hourly buckets without their identities ``dropped``, of which the distinct
    number stays. Days in ``done`` (day) are left out, so that none is absorbed twice."""
    rows = hourly.withColumn("day", (F.col("hour") - F.pmod(F.col("hour"), F.lit(DAY_MS))).cast("long"))
    if done is not None:
        rows = rows.join(done.select("day").distinct(), "day", "left_anti")
    return rows.groupBy("day", *keys).agg(F.sum("n").alias("n"), F.count("*").alias("buckets"), F.countDistinct("hour").alias("hours"), F.countDistinct(*dropped).alias("cells"), *[F.sum(c).alias(c) for c in sums])


def retention_plan(inventory: DataFrame, now_ms: int, budget: int | DataFrame, raw_days: int = 30, keep_days: int = 7) -> DataFrame:
    """(day, bytes, action) of raw partitions (day, bytes): 'compact' what is older than ``raw_days``; over the budget also
    the oldest full days of at least ``keep_days``, as long as what is newer exceeds it; today is never touched. The budget is
    a number, or a table of one row (budget)."""
    from pyspark.sql import Window

    age = F.floor((F.lit(now_ms) - F.col("day")) / DAY_MS)
    newer = F.sum("bytes").over(Window.orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0))  # a row per day
    if isinstance(budget, DataFrame):
        inventory, budget = inventory.crossJoin(F.broadcast(budget.select(F.col("budget").alias("_budget")))), F.col("_budget")  # one row joined on
    over = (newer > budget) & (age >= keep_days)
    return inventory.withColumn("action", F.when(age > raw_days, "compact").when(over, "compact").otherwise("keep")).drop("_budget")
