"""Faults of the network's side by repeated short-lived connections, with outside evidence.

A connection that ends before it settled, in service, is a failure; a fault is open while enough failures, spread over some
time, lie in the window, or while evidence from outside tells as many, and it clears after a quiet time without either. All by
windows along a subscription: for a failure it is known how long it and those before it keep the condition up, so the open
times are intervals, and intervals that touch are one fault. Ties in time go by ``order``; null keys are keys like others; rows
with a null time or state are left out; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .devices import fault_kind

# fixed values
WINDOW_MS, LEAST, SUSTAINED_MS, QUIET_MS, SETTLED_MS, FORGET_MS, EVIDENCE_MS = 3600000, 6, 300000, 900000, 120000, 86400000, 1200000


def short_lived(connections: DataFrame, keys: list[str], t: str, state: str, in_service: str, order: list[str], settled_ms: int = SETTLED_MS) -> DataFrame:
    """The rows of ``connections`` that end a connection which did not settle: a disconnect that is not told a second time in a row,
    less than ``settled_ms`` after the first connect since the last disconnect (or without one), not while known to be out of
    service."""
    rows = connections.where(F.col(t).isNotNull() & F.col(state).isNotNull())
    by = Window.partitionBy(*keys).orderBy(t, *order)
    down = F.col(state) == "DISCONNECTED"
    rows = rows.withColumn("_was", F.lag(state).over(by)).withColumn("_part", F.sum(down.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - down.cast("int"))
    part = Window.partitionBy(*keys, "_part").orderBy(t, *order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_since", F.min(F.when(F.col(state) == "CONNECTED", F.col(t))).over(part))
    held = F.coalesce(F.col(t) - F.col("_since"), F.lit(0))
    again = F.coalesce(F.col("_was") == "DISCONNECTED", F.lit(False))
    return rows.where(down & ~again & (held < settled_ms) & F.coalesce(F.col(in_service), F.lit(True))).drop("_was", "_part", "_since")


def carrier_faults(failures: DataFrame, evidence: DataFrame, keys: list[str], t: str, as_of: int, order: list[str] | None = None, window: int = WINDOW_MS, least: int = LEAST, sustained: int = SUSTAINED_MS, quiet: int = QUIET_MS, valid: int = EVIDENCE_MS, forget: int = FORGET_MS) -> DataFrame:
    """(keys, first_ms, last_ms, n, cause, kind, cleared_ms) of the faults that are open at ``as_of`` (cleared_ms null) or cleared at
    most ``forget`` before.

    A failure opens a fault, or holds it, if at least ``least`` failures lie in the ``window`` up to it, the first of them
    ``sustained`` or more before it. It does so until the failures it needs have left the window, but for ``quiet`` at least.
    ``evidence`` (keys, t, told, cause) with ``least`` or more told failures does so for ``valid``; of several the largest number
    told so far counts. n: the failures of the window at first and all that follow to the last that holds, or what evidence
    told, if that is more. The kind is by the cause of the last evidence, if that was valid at the last failure.
    """
    order = [t, *(order or [])]
    f = failures.where(F.col(t) <= as_of).select(*keys, F.col(t).alias("_t"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)])
    by = Window.partitionBy(*keys).orderBy("_t", *[f"_o{i}" for i in range(len(order))])
    near = Window.partitionBy(*keys).orderBy("_t")
    f = f.withColumns({
        "_place": F.count("*").over(near.rangeBetween(Window.unboundedPreceding, 0)), "_in": F.count("*").over(near.rangeBetween(-window, 0)), "_first": F.min("_t").over(near.rangeBetween(-window, 0)),
        "_needed": F.least(F.lag("_t", least - 1).over(by), F.max("_t").over(near.rangeBetween(Window.unboundedPreceding, -sustained))),
    })
    fires = (F.col("_in") >= least) & (F.col("_t") - F.col("_first") >= sustained)
    timed = f.where(fires).select(*keys, F.col("_t").alias("from"), F.greatest(F.col("_needed") + window, F.col("_t") + quiet).alias("until"), F.col("_first").alias("first"), (F.col("_place") - F.col("_in")).alias("before"), F.col("_place").alias("through"), F.lit(None).cast("long").alias("told"), F.lit(None).cast("string").alias("cause"))
    known = evidence.where(F.col(t).isNotNull() & (F.col(t) <= as_of)).withColumn("_most", F.max("told").over(Window.partitionBy(*keys).orderBy(t).rangeBetween(Window.unboundedPreceding, 0)))
    nothing = F.lit(None).cast("int")
    outside = known.where(F.col("_most") >= least).select(*keys, F.col(t).alias("from"), (F.col(t) + max(valid, quiet)).alias("until"), F.col(t).alias("first"), nothing.alias("before"), nothing.alias("through"), F.col("_most").cast("long").alias("told"), "cause")
    every = timed.union(outside)
    line = Window.partitionBy(*keys).orderBy("from", "until")
    every = every.withColumn("_new", F.coalesce(F.col("from") > F.max("until").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)))
    every = every.withColumn("_fault", F.sum(F.col("_new").cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda c, when: F.max_by(c, F.when(when, F.struct("from", c)))
    out = every.groupBy(*keys, "_fault").agg(
        F.min(F.struct("from", "first"))["first"].alias("first_ms"), F.max("from").alias("last_ms"), F.max("until").alias("_until"),
        F.greatest(F.coalesce(F.max("through") - F.min_by("before", F.when(F.col("through").isNotNull(), F.struct("from", "before"))), F.lit(0)).cast("long"), F.coalesce(F.max("told"), F.lit(0)), F.lit(1)).alias("n"),
        last("cause", F.col("cause").isNotNull()).alias("cause"), F.max(F.when(F.col("cause").isNotNull(), F.col("from"))).alias("_at"),
    )
    fresh = F.when(F.col("last_ms") - F.col("_at") <= valid, F.col("cause"))
    out = out.withColumn("kind", fault_kind(fresh)).withColumn("cleared_ms", F.when(F.col("_until") < as_of, F.col("_until")))
    return out.where(F.col("cleared_ms").isNull() | (as_of - F.col("cleared_ms") <= forget)).select(*keys, "first_ms", "last_ms", "n", "cause", "kind", "cleared_ms")

