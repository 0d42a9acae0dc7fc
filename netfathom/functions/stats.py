"""Statistics of weighted values: the five percentile rules, effective size, Wilson interval, dominant key.

Histograms are kept in long form (a row per value) until the end: maps can be neither grouped nor hashed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Z = 1.96  # fixed value


def wilson(p: Column, n: Column) -> Column:
    """struct(lo, hi), clamped to 0..1; [0, 1] without observations."""
    n = n.cast("double")
    mid = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    some = n > 0
    return F.struct(F.when(some, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0).alias("lo"), F.when(some, F.least(F.lit(1.0), mid + half)).otherwise(1.0).alias("hi"))


def effective_n(sum_w: Column, sum_w_sq: Column) -> Column:
    return F.when((sum_w > 0) & (sum_w_sq > 0), F.floor(sum_w.cast("double") * sum_w / sum_w_sq)).otherwise(0)


def fraction(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total)


def weighted_hist(df: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, weight): summed weights per value; rows without a value are left out. Without ``weight``, rows count."""
    w = F.sum(weight) if weight else F.count("*")
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(w.alias("weight"))


def hist_map(hist: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The long histogram as one map column per key."""
    return hist.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "weight")))).alias(name))


def percentiles(hist: DataFrame, keys: list[str], value: str, mode: str, **quantiles: float) -> DataFrame:
    """One row per key with a column per quantile, by one of five rules over (value, weight):

    A  the least value whose running weight reaches q * total; weights of 0 do not count, q is held to 0..1
    B  as A, without holding q
    C  the first value whose running weight exceeds round(q * (n - 1)), halves up
    D  the value at place floor(n * q), n - 1 at most
    E  the value at place n div 2
    """
    h = hist.where(F.col("weight") > 0)
    by = Window.partitionBy(*keys)
    h = h.withColumn("_run", F.sum("weight").over(by.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("weight").over(by))
    out = []
    for name, q in quantiles.items():
        n = F.col("_n")
        if mode in "AB":
            q = min(1.0, max(0.0, q)) if mode == "A" else q
            reached = F.col("_run") >= n * F.lit(float(q))
        elif mode == "C":
            reached = F.col("_run") > F.floor((n - 1) * F.lit(float(q)) + 0.5)
        elif mode == "D":
            reached = F.col("_run") > F.least(n - 1, F.floor(n * F.lit(float(q))))
        else:
            reached = F.col("_run") > F.floor(n / 2)
        out.append(F.coalesce(F.min(F.when(reached, F.col(value))), F.max(value)).alias(name))
    return h.groupBy(*keys).agg(*out)


def dominant(hist: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The value of the largest weight; ties to the smallest value."""
    best = F.min(F.struct((-F.col("weight")).alias("w"), F.col(value)))
    return hist.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col(f"b.{value}").alias(value))
