"""The map's derived measures: histograms and shares of bins, causes, summaries, overlaps, contributions, styles, sessions.

Histograms stay in long form (a row per value) beside the bins, so bins of any two sets of rows combine by adding.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hexgrid, radio
from ..functions.stats import dominant, effective_n, fraction, percentiles, weighted_hist, wilson
from .bins import SUMS
from .lineage import cut
from .intervals import bucketed_range_join
from .timeline import asof_join

# fixed values
K_DISPLAY, N_DISPLAY, SHARE_RES, SHARE_SAMPLES = 5, 30, 8, 5
NO_COLOUR = "#2a3240"
BAR_COLOURS = ["#8e2f28", "#c0562b", "#d8b32e", "#69b53a", "#1f9e5a"]
SINR_COLOURS = [(20, "#2f9e6b"), (13, "#46b07a"), (5, "#b8862f"), (0, "#a8642c"), (None, "#b03a42")]
ANCHOR_COLOURS = [(0.95, "#2f9e6b"), (0.88, "#5aa85a"), (0.75, "#cfa338"), (0.55, "#a8642c"), (None, "#b03a42")]


def bin_histograms(samples: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """(keys, measure, value, weight): time-weighted histograms of several columns (measure to column), values as text."""
    rows = samples.select(*keys, "weight_ms", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(c).cast("string").alias("value")) for m, c in values.items()])))
    return rows.where("value is not null").groupBy(*keys, "measure", "value").agg(F.sum("weight_ms").alias("weight"))


def bin_extent(samples: DataFrame, keys: list[str], device: str = "device_id") -> DataFrame:
    """(keys, contributors, first_ms, last_ms): devices counted once each, and when the bin was first and last seen."""
    return samples.groupBy(*keys).agg(F.countDistinct(device).alias("contributors"), F.min("wall_ms").alias("first_ms"), F.max("wall_ms").alias("last_ms"))


def cell_shares(samples: DataFrame, keys: list[str], cell: list[str]) -> DataFrame:
    """(keys, cell, samples, ms, place): the serving cells of a bin, those of most time first, then of most samples."""
    out = samples.groupBy(*keys, *cell).agg(F.count("*").alias("samples"), F.sum("weight_ms").alias("ms"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("ms"), F.desc("samples"), *cell)))


def collapse_overlaps(leaves: DataFrame) -> DataFrame:
    """Leaves (cell, plmn, sums) of which the finer ones are added to a coarser one of their network that claims their ground.
    Hosts of a leaf lie on one line of ancestors, and a host goes on into its own, so all end in the coarsest there is: one
    join on the ancestors, of which a leaf has four at most."""
    sums = [c for c in SUMS if c in leaves.columns]
    rows = leaves.groupBy("cell", "plmn").agg(*[F.sum(c).alias(c) for c in sums])
    line = cut(rows.select("cell", F.col("cell").alias("host")).distinct())
    above = [line]
    for res in range(hexgrid.FINEST - 1, hexgrid.COARSEST - 1, -1):
        line = cut(line.select("cell", hexgrid.parent(F.col("host"), res).alias("host")))
        above.append(line)
    lines = rows.select("cell", "plmn").join(reduce(DataFrame.union, above).distinct(), "cell")
    there = rows.select(F.col("cell").alias("host"), "plmn")
    best = lines.join(there, ["host", "plmn"]).groupBy("cell", "plmn").agg(F.min_by("host", hexgrid.res_of(F.col("host"))).alias("host"))
    out = rows.withColumn("units", hexgrid.child_units(hexgrid.res_of(F.col("cell")))).join(best, ["cell", "plmn"]).groupBy("host", "plmn").agg(*[F.sum(c).alias(c) for c in sums], F.sum("units").alias("units"), F.count("*").alias("leaves"))
    return out.withColumnRenamed("host", "cell").withColumn("units", F.least("units", hexgrid.child_units(hexgrid.res_of(F.col("cell")))))


def bin_measures(measured: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """Adds to measured bins the medians of signal, the dominant technology, band and network, the effective sample size, shares
    with intervals, the number of masts, and whether the bin may be shown to others (five contributors, thirty samples)."""
    p50 = lambda c: percentiles(weighted_hist(samples, keys, c, "weight_ms"), keys, c, "A", **{f"{c}_p50": 0.5})
    top = lambda c: dominant(weighted_hist(samples, keys, c, "weight_ms").where("weight > 0"), keys, c)
    masts = samples.groupBy(*keys).agg(F.countDistinct(radio.enb(F.col("rat"), F.col("ci"))).alias("masts"))
    out = reduce(lambda a, b: a.join(b, keys, "left"), [p50("rsrp"), p50("sinr"), top("rat"), top("band_label"), top("plmn"), masts, bin_extent(samples, keys)], measured.drop("rat"))
    fail, cold = wilson(F.coalesce("fail_rate", F.lit(0.0)), F.col("probe_n")), wilson(F.coalesce("cold_success", F.lit(0.0)), F.col("cold_n"))
    return out.withColumns({
        "effective_n": effective_n(F.col("ms"), F.col("ms_sq")).cast("long"), "validated": F.coalesce(fraction(F.col("validated_ms"), F.col("ms")), F.lit(0.0)),
        "fail_lo": fail["lo"], "fail_hi": fail["hi"], "cold_lo": cold["lo"], "cold_hi": cold["hi"], "publishable": (F.col("contributors") >= K_DISPLAY) & (F.col("n") >= N_DISPLAY),
    })


def cause() -> Column:
    """The code of a bin's cause, 0 for none: measured outcomes first; the signal only tells kinds of a measured failure apart."""
    c = F.col
    holds = [
        ((c("cell_route_n") == 0) & (c("probe_n") == 0), 0), (c("suspended") > 0.10, 5), ((c("cell_validated") < 0.80) & (F.coalesce("rsrp_p50", F.lit(0)) < -115), 1), (c("cell_validated") < 0.80, 6), (c("probe_fail") > 0, 6),
        ((c("reselect_rate") > 2) & (c("speed_kph") < 5), 3), ((c("flaps") > 0) & (c("wifi_ms") * 2 > c("ms")), 7),
    ]
    return reduce(lambda out, h: F.when(F.coalesce(h[0], F.lit(False)), h[1]).otherwise(out), reversed(holds), F.lit(0))


def map_summary(bins: DataFrame, samples: DataFrame, keys: list[str]) -> DataFrame:
    """One row over classified, measured bins: how many are surveyed, thin, bad, bad with full bars, bad and weak, surveyed but
    not measured; and the median signal pooled over the time of the bad ones."""
    bad, seen = F.col("outcome") == "ROUTE_LOSS", F.col("outcome") != "UNSURVEYED"
    out = bins.agg(
        F.count("*").alias("bins"), F.count_if(seen).alias("surveyed"), F.count_if(~seen).alias("thin"), F.count_if(bad).alias("bad"), F.count_if(bad & (radio.carrier_bars(F.col("rsrp_p50")) >= 4)).alias("bad_full_bars"),
        F.count_if(bad & (F.coalesce("rsrp_p50", F.lit(0)) < -108)).alias("bad_weak"), F.count_if((F.col("n") >= 8) & (F.col("cell_route_n") == 0) & (F.col("probe_n") == 0)).alias("not_measured"), F.sum("cold_n").alias("cold_n"), F.sum("cold_fail").alias("cold_fail"),
    )
    pooled = weighted_hist(samples.join(bins.where(bad).select(*keys), keys, "left_semi").withColumn("_all", F.lit(1)), ["_all"], "rsrp", "weight_ms")
    median = percentiles(pooled, ["_all"], "rsrp", "A", median_bad_rsrp=0.5).drop("_all")
    return out.join(median, how="left", on=F.lit(True))  # one row each


def layer_style(bins: DataFrame) -> DataFrame:
    """Adds the opacity (confidence) and the colours of the signal layers to measured, classified bins."""
    steps = lambda c, table: reduce(lambda out, s: F.when(c >= s[0], s[1]).otherwise(out), reversed(table[:-1]), F.lit(table[-1][1]))
    sure = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.log10(F.greatest(F.col("n"), F.lit(1)).cast("double")) - 0.9) / 2.3))
    bars = F.element_at(F.array(*map(F.lit, BAR_COLOURS)), radio.carrier_bars(F.col("rsrp_p50")) + 1)
    return bins.withColumns({
        "opacity": F.when(F.col("outcome") == "UNSURVEYED", 0.30).otherwise(0.34 + 0.46 * sure), "rsrp_colour": F.when(F.col("rsrp_p50").isNull(), NO_COLOUR).otherwise(bars),
        "sinr_colour": F.when(F.col("sinr_p50").isNull(), NO_COLOUR).otherwise(steps(F.col("sinr_p50"), SINR_COLOURS)), "anchor_colour": steps(F.col("anchor"), ANCHOR_COLOURS),
    })


def build_contribution(samples: DataFrame, cell: str, contributor: str, t: str) -> DataFrame:
    """(contributor, area, network, band, samples, observed_ms, rsrp, sinr, week) to share: per area of resolution 8, network and
    band. A bin's samples go to its bands by their time, cut down to whole ones per bin before they are added up; records of
    fewer than five are left out, and so are bands without any signal. No identities; times are ISO weeks."""
    keys = [contributor, cell]
    rows = samples.withColumn("_band", radio.share_label(F.col("rat"), F.col("band"))).where(F.col("plmn").isNotNull())
    n = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("weight_ms").alias("_all"))
    network = dominant(weighted_hist(rows, keys, "plmn", "weight_ms"), keys, "plmn")
    bands = rows.where("_band is not null").groupBy(*keys, "_band").agg(F.sum("weight_ms").alias("_ms"), (F.count("rsrp") + F.count("sinr")).alias("_some")).where("_some > 0")
    parts = bands.join(n.where("_all > 0"), keys).join(network, keys).withColumn("_s", F.floor(F.col("_n") * (F.col("_ms").cast("double") / F.col("_all"))))
    area = hexgrid.parent(F.col(cell), SHARE_RES).cast("string")
    own = ["area", "network", "band"]
    parts = parts.select(contributor, cell, F.col("_band").alias("band"), F.col("plmn").alias("network"), area.alias("area"), "_s", "_ms")
    out = parts.groupBy(contributor, *own).agg(F.sum("_s").alias("samples"), F.sum("_ms").alias("observed_ms")).where(F.col("samples") >= SHARE_SAMPLES)
    for h in ("rsrp", "sinr"):
        hist = weighted_hist(rows.drop("band").withColumnRenamed("_band", "band"), [*keys, "band"], h, "weight_ms").join(parts.select(contributor, cell, "band", "network", "area"), [*keys, "band"])
        merged = hist.groupBy(contributor, *own, h).agg(F.sum("weight").cast("double").alias("w")).groupBy(contributor, *own).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(h).cast("double"), "w")))).alias(h))
        out = out.join(merged, [contributor, *own], "left")
    last = rows.groupBy(contributor).agg(F.max(t).alias("_t"))
    return out.join(last, contributor).withColumn("week", iso_week(F.col("_t"))).drop("_t")


def iso_week(ms: Column) -> Column:
    """The ISO week of a time, as 2026-W53: the year is that of the week's Thursday."""
    day = F.timestamp_millis(ms)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), day).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(day).cast("string"), 2, "0"))


def session_summary(sessions: DataFrame, radio_rows: DataFrame, probes: DataFrame, outcomes: DataFrame, keys: list[str], t: str = "wall_ms", bucket: int = 120000) -> DataFrame:
    """Sessions (keys, start_ms, end_ms) with what happened within: readings, distinct cells, cell changes with their outcomes,
    probes (kind) and failures, percentiles of the signal to noise, and the share of the time that readings cover."""
    s = sessions.select(*keys, "start_ms", "end_ms")
    own = [*keys, "start_ms"]
    within = lambda df: bucketed_range_join(df, s, keys, t, "start_ms", "end_ms", bucket)
    r = within(radio_rows)
    counts = r.groupBy(*own).agg(F.count("*").alias("readings"), F.countDistinct("ci").alias("distinct_cells"), F.sum("weight_ms").alias("_w"))
    pct = percentiles(weighted_hist(r, own, "sinr"), own, "sinr", "D", sinr_p10=0.1, sinr_p50=0.5, sinr_p90=0.9)
    o = within(outcomes).groupBy(*own).agg(F.count("*").alias("cell_changes"), *[F.count_if(F.col("outcome") == v).alias(n) for n, v in (("clean", "clean"), ("failed", "failed"), ("returns", "ping-pong"))])
    p = within(probes).groupBy(*own).agg(F.count("*").alias("probes"), F.count_if((F.col("outcome") != "OK") & ~F.col("kind").isin("INSTRUMENT", "RECOVERY", "NO_BEARER")).alias("probe_fail"))
    out = reduce(lambda a, b: a.join(b, own, "left"), [counts, pct, o, p], s)
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("readings", "distinct_cells", "cell_changes", "clean", "failed", "returns", "probes", "probe_fail")}
    return out.withColumns(zero).withColumn("coverage", F.least(F.lit(1.0), F.coalesce(fraction(F.col("_w"), F.col("end_ms") - F.col("start_ms")), F.lit(0.0)))).drop("_w")


def journey_verdict(summaries: DataFrame) -> DataFrame:
    """Adds ``verdict``: unreadable below 30 % coverage, too few below five judged changes, else by the share that failed."""
    judged = F.col("failed") + F.col("clean")
    share = F.col("failed") / judged
    return summaries.withColumn("verdict", F.when(F.col("coverage") < 0.30, "unreadable").when(judged < 5, "too few").when(share >= 0.25, "bad").when(share >= 0.10, "watch").otherwise("clean"))


def mobility_class(rows: DataFrame, fixes: DataFrame, keys: list[str], t: str, order: list[str], window: int = 180000) -> DataFrame:
    """Adds class and confidence to rows (ci, tac, fresh): by the speed of a fix of the last two minutes; else by a change of the
    tracking area in the last five; else, from a minute of observation on of which 30 % is fresh, by how many distinct cells
    and cell changes a minute the last ``window`` had. A window is three minutes of rows."""
    by, near = Window.partitionBy(*keys).orderBy(*order), Window.partitionBy(*keys).orderBy(t).rangeBetween(-window, 0)
    placed = asof_join(rows, fixes.where("speed is not null"), keys, t, ["speed"], max_age=120000)
    moved = lambda c: F.coalesce(F.col(c) != F.lag(c).over(by), F.lit(False))
    x = placed.withColumn("_moved", moved("ci").cast("int")).withColumn("_tac", F.when(moved("tac"), F.col(t)))
    x = x.withColumn("_tac", F.last("_tac", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_from", F.min(t).over(Window.partitionBy(*keys)))
    x = x.withColumn("_n", F.count("*").over(near)).withColumn("_fresh", F.sum(F.col("fresh").cast("int")).over(near)).withColumn("_cells", F.size(F.collect_set("ci").over(near)))
    x = x.withColumn("_changes", F.sum("_moved").over(near) - F.min_by("_moved", F.struct(*order)).over(near))  # the first row's change came from before the window
    span = F.least(F.lit(window), F.col(t) - F.col("_from"))
    rate = lambda c: fraction(F.col(c), span / 60000)
    by_speed = F.when(F.col("speed") < 0.5, "STATIONARY").when(F.col("speed") < 2.5, "WALKING").when(F.col("speed") < 22, "VEHICLE").otherwise("FAST")
    churn = F.when(rate("_cells") >= 3, "FAST").when(rate("_cells") >= 1, "VEHICLE").when(rate("_changes") >= 1, "WALKING").otherwise("STATIONARY")
    fast, tac = F.col("speed").isNotNull(), F.coalesce(F.col(t) - F.col("_tac") <= 300000, F.lit(False))
    blind = (span < 60000) | (F.col("_fresh") < 0.30 * F.col("_n"))
    out = x.withColumn("class", F.when(fast, by_speed).when(tac, "VEHICLE").when(blind, "UNKNOWN").otherwise(churn))
    return out.withColumn("confidence", F.when(fast, "MEASURED").when(tac, "INDICATIVE").when(blind, "NONE").otherwise("WEAK")).drop("_moved", "_tac", "_from", "_n", "_fresh", "_cells", "_changes")


def here_card(latest: DataFrame, sites: DataFrame) -> DataFrame:
    """Adds to the latest row of each phone (share and n of poor readings of the last ten minutes; plmn, enb, band, hour) the grade
    of the area and what its mast was like at this hour: bad, fine, or no record."""
    grade = F.when(F.col("n") < 30, "UNKNOWN").when(F.col("share") >= 0.70, "BAD").when(F.col("share") > 0.30, "MARGINAL").otherwise("GOOD")
    out = latest.join(sites.select("plmn", "enb", "band", "hour", F.col("verdict").alias("_v"), F.col("share").alias("site_share")), ["plmn", "enb", "band", "hour"], "left")
    return out.withColumn("grade", grade).withColumn("before", F.when(F.col("_v") == "bad", "poor").when(F.col("_v") == "good", "fine").otherwise("no record")).drop("_v")


def tile_cover(boxes: DataFrame, budget: int = 3500, ceiling: int = 9, floor: int = 5) -> DataFrame:
    """Adds zoom and tiles to boxes (west, south, east, north): the finest zoom whose tiles fit the budget, else the coarsest. A
    box may cross the antimeridian."""
    from .devices import tile_xy

    def tiles(z: int) -> Column:
        x0, y0 = tile_xy(F.col("north"), F.col("west"), z)
        x1, y1 = tile_xy(F.col("south"), F.col("east"), z)
        across = F.when(F.col("west") <= F.col("east"), x1 - x0 + 1).otherwise((1 << z) - x0 + x1 + 1)
        return across.cast("long") * (y1 - y0 + 1)

    zoom = reduce(lambda out, z: F.when(tiles(z) <= budget, z).otherwise(out), range(floor, ceiling + 1), F.lit(floor))
    n = reduce(lambda out, z: F.when(F.col("zoom") == z, tiles(z)).otherwise(out), range(floor, ceiling + 1), F.lit(0).cast("long"))
    return boxes.withColumn("zoom", zoom).withColumn("tiles", n)
