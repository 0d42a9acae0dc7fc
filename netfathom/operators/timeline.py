"""Operators along a device's time: boots, dwell weights, as-of and bracket joins, changes.

Values that are carried along a key's time are found by segments of it (``segments.along``), so a device of any size is shared by
tasks. Ties in time go by the given order columns. Rows with a null time take part in no join and get no weight.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hexgrid
from .segments import SEGMENT_MS, along

MAX_AGE_MS, MAX_SKEW_MS = 60000, 1000  # fixed values

BOOT_SPLIT_MS, CAP_MS, BRACKET_MS = 60000, 30000, 180000  # fixed values
LOCATE_SPAN_MS = 3600 * 1000


def boot_starts(streams: list[DataFrame], device: str = "device_id", wall: str = "wall_ms", elapsed: str = "elapsed_ms") -> DataFrame:
    """(device, boot, start): a boot begins where the offset wall - elapsed, over all streams, is more than a minute above
    the previous offset."""
    offsets = reduce(DataFrame.union, [s.select(device, (F.col(wall) - F.col(elapsed)).alias("start")) for s in streams]).where("start is not null").distinct()
    by = Window.partitionBy(device).orderBy("start")
    gap = F.col("start") - F.lag("start").over(by)
    starts = offsets.withColumn("_gap", gap).where(F.col("_gap").isNull() | (F.col("_gap") > BOOT_SPLIT_MS)).drop("_gap")
    return starts.withColumn("boot", F.row_number().over(by) - 1)


def assign_boot(df: DataFrame, starts: DataFrame, device: str = "device_id", wall: str = "wall_ms", elapsed: str = "elapsed_ms") -> DataFrame:
    """Adds ``boot``: the last start at or before the row's offset, or the first. Joined once per distinct offset, so the
    rows themselves meet an equality join only."""
    rows = df.withColumn("_offset", F.col(wall) - F.col(elapsed))
    offsets = rows.select(device, "_offset").distinct()
    marks = starts.select(device, F.col("start").alias("_offset"), "boot")
    by = Window.partitionBy(device).orderBy("_offset", F.col("boot").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    told = offsets.withColumn("boot", F.lit(None).cast("int")).union(marks).withColumn("_boot", F.coalesce(F.last("boot", ignorenulls=True).over(by), F.lit(0)))
    return rows.join(told.where("boot is null").select(device, "_offset", F.col("_boot").alias("boot")), [device, "_offset"]).drop("_offset")


def time_weight(df: DataFrame, keys: list[str], t: str = "elapsed_ms", order: list[str] | None = None, cap_ms: int = CAP_MS, span_ms: int = SEGMENT_MS) -> DataFrame:
    """Adds ``weight_ms``: the time to the next row of the same keys, 0 to ``cap_ms``; 0 for the last."""
    rows = along(df, keys, t, [t, *(order or [])], upcoming={"_next": F.col(t)}, span_ms=span_ms)
    gap = F.col("_next") - F.col(t)
    return rows.withColumn("weight_ms", F.when(gap.isNull(), 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(cap_ms), gap))).cast("long")).drop("_next")  # least() passes over nulls


def coverage(weighted: DataFrame, keys: list[str], wall: str = "wall_ms") -> DataFrame:
    """(keys, observed_ms, span_ms, coverage) of weighted rows."""
    span = F.max(wall) - F.min(wall)
    return weighted.groupBy(*keys).agg(F.sum("weight_ms").alias("observed_ms"), span.alias("span_ms")).withColumn("coverage", F.when(F.col("span_ms") > 0, F.col("observed_ms") / F.col("span_ms")))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], t: str, columns: list[str], max_age: int | None = None, span_ms: int = SEGMENT_MS) -> DataFrame:
    """Adds ``columns`` of the last right row of the same keys at or before each left row (at ties the right row counts),
    null if there is none or it is older than ``max_age``. One union and one scan along the keys; no range join."""
    names = left.columns
    kept = left.select(F.struct(*names).alias("_l"), *keys, F.col(t).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns, F.col(t).alias("_at")).alias("r")).schema["r"].dataType).alias("_r"))
    other = right.select(F.lit(None).cast(kept.schema["_l"].dataType).alias("_l"), *keys, F.col(t).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns, F.col(t).alias("_at")).alias("_r"))
    both = along(kept.union(other), keys, "_t", ["_t", "_side"], last={"_before": F.col("_r")}, span_ms=span_ms).where("_side = 1").drop("_r").withColumnRenamed("_before", "_r")
    if max_age is not None:
        both = both.withColumn("_r", F.when(F.col("_t") - F.col("_r._at") <= max_age, F.col("_r")))
    return both.select("_l.*", *[F.col(f"_r.{c}").alias(c) for c in columns])


def locate(df: DataFrame, fixes: DataFrame, keys: list[str], t: str, cell: str, speed: str, window_ms: Column, order: str = "id", span_ms: int = LOCATE_SPAN_MS) -> DataFrame:
    """Adds ``cell`` and ``speed`` of the place of each row.

    Where the fixes before (at or before) and after are in one cell and at most three minutes apart, that cell and the mean
    of their speeds; else the nearer fix within its own window (``window_ms``, an expression on the fix of at most
    ``BRACKET_MS``), at ties the one before; else null. As no fix reaches further than ``BRACKET_MS``, a key's line is cut into
    spans, each with the fixes of that much on either side: one exchange, and a key of any size is shared by tasks.
    """
    names = df.columns
    span = lambda at: F.floor(at / span_ms)
    reach = F.when(F.col(t).isNotNull(), F.sequence(span(F.col(t) - BRACKET_MS), span(F.col(t) + BRACKET_MS)))
    fix = fixes.withColumn("_w", window_ms).select(*keys, F.explode(reach).alias("_span"), F.col(t).alias("_t"), F.struct(F.col(t).alias("t"), F.col(cell).alias("cell"), F.col(speed).alias("speed"), F.col("_w").alias("w")).alias("_f"), F.col(order).alias("_o"))
    rows = df.select(*keys, span(F.col(t)).alias("_span"), F.col(t).alias("_t"), F.struct(*names).alias("_l"))
    both = fix.withColumn("_l", F.lit(None).cast(rows.schema["_l"].dataType)).withColumn("_side", F.lit(0)).unionByName(rows.withColumn("_f", F.lit(None).cast(fix.schema["_f"].dataType)).withColumn("_o", F.lit(None).cast(fix.schema["_o"].dataType)).withColumn("_side", F.lit(1)))
    at = ["_t", "_side", "_o"]
    part = Window.partitionBy(*keys, "_span")
    ahead = part.orderBy(*(F.desc(c) for c in at)).rowsBetween(Window.unboundedPreceding, -1)  # a frame that grows; one that shrinks is evaluated anew for each row
    both = both.withColumn("p", F.last("_f", ignorenulls=True).over(part.orderBy(*at).rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.last("_f", ignorenulls=True).over(ahead)).where("_side = 1")
    bracket = F.coalesce((F.col("p.cell") == F.col("n.cell")) & (F.col("n.t") - F.col("p.t") <= BRACKET_MS), F.lit(False))
    d_p, d_n = F.col("_t") - F.col("p.t"), F.col("n.t") - F.col("_t")
    ok_p, ok_n = F.coalesce(d_p <= F.col("p.w"), F.lit(False)), F.coalesce(d_n <= F.col("n.w"), F.lit(False))
    near = F.when(ok_p & (~ok_n | (d_p <= d_n)), F.col("p")).when(ok_n, F.col("n"))
    mean = F.when(F.col("p.speed").isNull(), F.col("n.speed")).when(F.col("n.speed").isNull(), F.col("p.speed")).otherwise((F.col("p.speed") + F.col("n.speed")) / 2)
    return both.select("_l.*", F.when(bracket, F.col("p.cell")).otherwise(near["cell"]).alias(cell), F.when(bracket, mean).otherwise(near["speed"]).alias(speed))


def mark_cold(probes: DataFrame, keys: list[str], t: str = "wall_ms", latency: str = "latency_ms", on_bearer: Column | None = None, gap_ms: int = 30000, order: str = "id", span_ms: int = SEGMENT_MS) -> DataFrame:
    """Adds ``cold``: an on-bearer probe that starts more than ``gap_ms`` after the previous on-bearer one, or is the first."""
    bearer = on_bearer if on_bearer is not None else F.lit(True)
    rows = along(probes, keys, t, [t, order], last={"_before": F.when(bearer, F.col(t))}, own=False, span_ms=span_ms)
    return rows.withColumn("cold", F.coalesce(bearer, F.lit(False)) & F.coalesce(F.col(t) - F.col(latency) - F.col("_before") > gap_ms, F.lit(True))).drop("_before")


def changes_only(df: DataFrame, keys: list[str], signature: list[str], order: list[str]) -> DataFrame:
    """Rows whose signature differs from the previous one of their keys (nulls are a value), and the first of each."""
    by = Window.partitionBy(*keys).orderBy(*order)
    sig = F.struct(*signature)
    return df.withColumn("_before", F.lag(sig).over(by)).withColumn("_first", F.row_number().over(by) == 1).where(F.col("_first") | ~F.col("_before").eqNullSafe(sig)).drop("_before", "_first")


def admit_fixes(fixes: DataFrame, keys: list[str], t: str = "elapsed_ms", accuracy: str = "accuracy_m", lat: str = "lat", order: str = "id", mock: str | None = None, now: str | None = None) -> DataFrame:
    """Adds ``reject``: why a fix is refused, else null: it is made up ("mock"); it has no time of measurement, or one more than
    ``MAX_AGE_MS`` before or ``MAX_SKEW_MS`` after its arrival ``now`` ("stale"); it is not later than the last one admitted
    ("order"); or no resolution of the grid fits its accuracy ("accuracy")."""
    fake = F.coalesce(F.col(mock), F.lit(False)) if mock else F.lit(False)
    timed = F.col(t).isNotNull() & (F.col(now) - F.col(t)).between(-MAX_SKEW_MS, MAX_AGE_MS) if now else F.col(t).isNotNull()
    fine = hexgrid.res_for_accuracy(F.col(accuracy), F.col(lat)).isNotNull()
    by = Window.partitionBy(*keys).orderBy("wall_ms", order).rowsBetween(Window.unboundedPreceding, -1)
    # of the fixes that pass the other tests, the latest so far is the last one admitted
    late = F.col(t) <= F.max(F.when(~fake & timed & fine, F.col(t))).over(by)
    return fixes.withColumn("reject", F.when(fake, "mock").when(~timed, "stale").when(late, "order").when(~fine, "accuracy"))
