"""Coverage bins: measures per cell and subscription, the winning subscription, probes, and outcome classes.

Accumulators are sums only, so bins of any two sets of rows combine by adding; contributors are counted from (cell, device)
pairs and never summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import fraction, percentiles, weighted_hist, wilson

# fixed values of the outcome rules
MIN_SAMPLES, FLAP_CEILING, VALIDATED_FLOOR, ANCHOR_FLOOR, RESELECT_CEILING, WALKING_KPH = 8, 4.0, 0.80, 0.60, 2, 5
FAIL_RATE_LOSS, SUCCESS_FLOOR, SLOW_P90_MS, MIN_LATENCIES = 0.05, 0.95, 1500, 3
SUMS = ["n", "ms", "ms_sq", "validated_ms", "suspended_ms", "cell_route_ms", "cell_route_n", "cell_validated_ms", "wifi_ms", "cell_changes", "speed_ms", "speed_mps_ms", "nr_ms"]


def cell_changes(samples: DataFrame, keys: list[str], identity: str, order: list[str]) -> DataFrame:
    """Adds ``changed``: the row's serving cell differs from the previous known one of the same keys (bin, subscription)."""
    before = F.last(identity, ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return samples.withColumn("changed", F.coalesce(F.col(identity) != before, F.lit(False)))


def bin_leaves(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per key of located, weighted samples with their route (transport, validated, not_suspended), speed, rat and
    ``changed``."""
    w = F.col("weight_ms")
    when = lambda c: F.sum(F.when(c, w).otherwise(0))
    cellular = F.col("transport") == "CELLULAR"
    return samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum(w).alias("ms"), F.sum(w * w).alias("ms_sq"), when(F.col("validated")).alias("validated_ms"), when(~F.col("not_suspended")).alias("suspended_ms"),
        when(cellular).alias("cell_route_ms"), F.count_if(cellular).alias("cell_route_n"), when(cellular & F.col("validated")).alias("cell_validated_ms"), when(F.col("transport") == "WIFI").alias("wifi_ms"),
        F.count_if("changed").alias("cell_changes"), when(F.col("speed").isNotNull()).alias("speed_ms"), F.sum(F.coalesce(F.col("speed"), F.lit(0.0)) * w).alias("speed_mps_ms"), when(F.col("rat") == "NR").alias("nr_ms"),
    )


def combine(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Bins of the same keys added up."""
    return bins.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS if c in bins.columns])


def pick_subscription(leaves: DataFrame, cell: str, sub: str) -> DataFrame:
    """Of each cell's subscriptions the one of most time, then samples, then the lowest; ``other_n``: samples of the others."""
    by = Window.partitionBy(cell)
    ranked = leaves.withColumn("_r", F.row_number().over(by.orderBy(F.desc("ms"), F.desc("n"), sub))).withColumn("other_n", F.sum("n").over(by) - F.col("n"))
    return ranked.where("_r = 1").drop("_r")


def probe_bins(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Probe counts per key of located probes (outcome, latency_ms, cold, on_bearer): cold ones count on the bearer only."""
    on, fail = F.col("on_bearer"), F.col("outcome") == "FAIL"
    return probes.groupBy(*keys).agg(F.count_if(on).alias("probe_n"), F.count_if(on & fail).alias("probe_fail"), F.count_if(~on).alias("no_bearer_n"), F.count_if(on & F.col("cold")).alias("cold_n"), F.count_if(on & F.col("cold") & fail).alias("cold_fail"))


def probe_latencies(probes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, latency_bin, weight): the latencies of the probes on the bearer that succeeded, each value with its count."""
    ok = probes.where(F.col("on_bearer") & (F.col("outcome") == "OK")).withColumn("latency_bin", F.col("latency_ms"))
    return weighted_hist(ok, keys, "latency_bin")


def latency_p90(hist: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ok_n, p90_ms) of latency histograms."""
    return hist.groupBy(*keys).agg(F.sum("weight").alias("ok_n")).join(percentiles(hist, keys, "latency_bin", "C", p90_ms=0.90), keys)


def measure_columns() -> tuple[dict[str, Column], dict[str, Column]]:
    """The counts that may be null, as 0, and the derived measures of bins that have them."""
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("flaps", "probe_n", "probe_fail", "cold_n", "cold_fail", "ok_n")}
    minutes = F.greatest(F.col("ms") / 60000, F.lit(1 / 60))
    ratio = lambda a, b: fraction(F.col(a), F.col(b))
    return zero, {
        "anchor": F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("flaps") / minutes / FLAP_CEILING)), "reselect_rate": F.col("cell_changes") / minutes,
        "speed_kph": F.coalesce(fraction(F.col("speed_mps_ms"), F.col("speed_ms")), F.lit(0.0)) * 3.6, "cell_validated": ratio("cell_validated_ms", "cell_route_ms"), "suspended": F.coalesce(ratio("suspended_ms", "ms"), F.lit(0.0)),
        "fail_rate": ratio("probe_fail", "probe_n"), "cold_success": fraction(F.col("cold_n") - F.col("cold_fail"), F.col("cold_n")),
    }


def measures(bins: DataFrame) -> DataFrame:
    """Adds derived measures to bins with flaps, probe counts and the latencies' count and p90 (null counts as 0; bins
    without columns of latencies have none)."""
    bins = bins.withColumns({c: F.lit(None).cast("long") for c in ("ok_n", "p90_ms") if c not in bins.columns})
    zero, more = measure_columns()
    return bins.withColumns(zero).withColumns(more)


def rules() -> list[tuple[Column, str]]:
    """The outcome rules in order; the first that holds decides."""
    c = F.col
    fail = F.coalesce(c("fail_rate"), F.lit(0.0))
    low = wilson(fail, c("probe_n"))["lo"]
    return [
        (c("n") < MIN_SAMPLES, "UNSURVEYED"),
        ((c("cell_route_n") == 0) & (c("probe_n") == 0), "UNSURVEYED"),
        (c("cell_validated") < VALIDATED_FLOOR, "ROUTE_LOSS"),
        ((c("probe_n") > 0) & (low > FAIL_RATE_LOSS), "ROUTE_LOSS"),
        (c("anchor") < ANCHOR_FLOOR, "ANCHOR"),
        ((c("reselect_rate") > RESELECT_CEILING) & (c("speed_kph") < WALKING_KPH), "RESELECT"),
        (c("cold_success") < SUCCESS_FLOOR, "SLOW"),
        (c("fail_rate") > 1 - SUCCESS_FLOOR, "SLOW"),
        ((c("ok_n") >= MIN_LATENCIES) & (c("p90_ms") > SLOW_P90_MS), "SLOW"),
        ((c("nr_ms") * 2 > c("ms")), "NSA"),
    ]


def outcome_columns() -> dict[str, Column]:
    """The outcome, and the number of the rule that told it from 1, 0 if every test passed."""
    outcome, rule = F.lit("LTE"), F.lit(0)
    for k, (holds, name) in reversed(list(enumerate(rules(), 1))):
        holds = F.coalesce(holds, F.lit(False))
        outcome, rule = F.when(holds, name).otherwise(outcome), F.when(holds, k).otherwise(rule)
    return {"outcome": outcome, "rule": rule}


def classify(measured: DataFrame) -> DataFrame:
    """Adds ``outcome`` and ``rule``."""
    return measured.withColumns(outcome_columns())
