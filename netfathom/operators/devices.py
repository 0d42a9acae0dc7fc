"""Operators on a device's course: journeys, excursions, places held, predictions, faults, and health.

State machines with dwell times depend on the order of rows and run along them, holding one window at most.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentiles, weighted_hist, wilson
from .intervals import _islands, gap_cluster
from .ordered import in_order
from .timeline import changes_only

# fixed values
QUIET_MS, MIN_ACTIVE_MS, WALKING_MPS = 180000, 60000, 0.5
STALE_MS = {"signal": 15000, "service": 600000, "cell": 120000}
ENTER, LEAVE, WINDOW_MS, LEAST, DWELL_MS = 0.70, 0.30, 600000, 30, 900000


def journeys(fixes: DataFrame, keys: list[str], t: str, speed: str) -> DataFrame:
    """(keys, start_ms, end_ms, n): stretches above walking speed that no quiet time of three minutes parts, of a minute or
    more."""
    return gap_cluster(fixes.where(F.col(speed) > WALKING_MPS), keys, t, QUIET_MS, ["id"]).where(F.col("end_ms") - F.col("start_ms") >= MIN_ACTIVE_MS)


def area_states(times: list[int], bad: list[bool], window: int = WINDOW_MS, least: int = LEAST, dwell: int = DWELL_MS) -> list[bool]:
    """Whether the area counts as poor at each row: entered at a share of ``ENTER`` bad rows over the window, left at
    ``LEAVE``, with ``dwell`` between changes; unknown shares (fewer than ``least`` rows) change nothing."""
    out, poor, since, lo, n_bad = [], False, -math.inf, 0, 0
    for i, t in enumerate(times):
        n_bad += bad[i]
        while times[lo] < t - window:
            n_bad -= bad[lo]
            lo += 1
        n = i - lo + 1
        if n >= least and t - since >= dwell:
            share = n_bad / n
            if not poor and share >= ENTER or poor and share <= LEAVE:
                poor, since = not poor, t
        out.append(poor)
    return out


def _areas_along(t: int, bad: int, window: int = WINDOW_MS, least: int = LEAST, dwell: int = DWELL_MS):
    """``area_states`` for rows that pass by, with the places of their columns: holds counts per time of one window."""
    def rule(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: deque[list[int]] = deque()  # time, rows, bad rows
        poor, since, n, n_bad = False, -math.inf, 0, 0
        for row in rows:
            if not held or held[-1][0] != row[t]:
                held.append([row[t], 0, 0])
            held[-1][1] += 1
            held[-1][2] += bool(row[bad])
            n, n_bad = n + 1, n_bad + bool(row[bad])
            while held[0][0] < row[t] - window:
                _, gone, gone_bad = held.popleft()
                n, n_bad = n - gone, n_bad - gone_bad
            if n >= least and row[t] - since >= dwell:
                share = n_bad / n
                if not poor and share >= ENTER or poor and share <= LEAVE:
                    poor, since = not poor, row[t]
            yield (*row, poor)

    return rule


def area_state(rows: DataFrame, keys: list[str], t: str, bad: str, order: list[str], **limits: int) -> DataFrame:
    """Adds ``poor``."""
    schema = rows.withColumn("poor", F.lit(True)).schema
    return in_order(rows, keys, order, schema, _areas_along(rows.columns.index(t), rows.columns.index(bad), **limits))


def kept_times(times: list[int], keys: list, every: int = 60000) -> list[bool]:
    """Which rows to keep: the first of each run of a key, then one each ``every``, and the last of a run that is left."""
    keep, last = [False] * len(times), None
    for i, t in enumerate(times):
        if i == 0 or keys[i] != keys[i - 1]:
            keep[i], last = True, t
            if i:
                keep[i - 1] = True
        elif t - last >= every:
            keep[i], last = True, t
    return keep


def _kept_along(t: int, edge: int, every: int):
    """The rows of one run that are kept: those a time ``every`` or more after the last such one, and those marked."""
    def rule(rows: Iterator[tuple]) -> Iterator[tuple]:
        last = None
        for row in rows:
            due = last is None or row[t] - last >= every
            last = row[t] if due else last
            if due or row[edge]:
                yield row

    return rule


def thin(rows: DataFrame, keys: list[str], t: str, value: str, order: list[str], every: int = 60000) -> DataFrame:
    """The rows that ``kept_times`` keeps. The runs of a key are independent of each other."""
    by = Window.partitionBy(*keys).orderBy(*order)
    fresh = ~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)
    left = F.lead(F.lit(1)).over(by).isNotNull() & ~F.col(value).eqNullSafe(F.lead(value).over(by))
    runs = _islands(rows.withColumn("_left", left), keys, order, fresh)
    return in_order(runs, [*keys, "_island"], order, runs.schema, _kept_along(runs.columns.index(t), runs.columns.index("_left"), every)).drop("_left", "_island")


def repeated_failures(failures: DataFrame, keys: list[str], t: str, window: int = 3600000, least: int = 6, span: int = 300000, quiet: int = 900000) -> DataFrame:
    """(keys, start_ms, end_ms, n): faults open where ``least`` failures spanning ``span`` fall into the window before, and
    clear after ``quiet`` without one that holds them open."""
    by = Window.partitionBy(*keys).orderBy(t).rangeBetween(-window, 0)
    open_ = failures.withColumn("_n", F.count("*").over(by)).withColumn("_lo", F.min(t).over(by)).where((F.col("_n") >= least) & (F.col(t) - F.col("_lo") >= span))
    return gap_cluster(open_, keys, t, quiet, ["id"])


def throttled(rows: DataFrame, keys: list[str], t: str, order: list[str], gap: int) -> DataFrame:
    """The rows of each key that come ``gap`` or more after the last one kept; the first is."""

    def rule(own: Iterator[tuple], at: int = rows.columns.index(t)) -> Iterator[tuple]:
        last = None
        for row in own:
            if last is None or row[at] - last >= gap:
                last = row[at]
                yield row

    return in_order(rows, keys, order, rows.schema, rule)


def handover_predictions(readings: DataFrame, keys: list[str], t: str, level: str, validated: str, lost: str, order: list[str], reach: int = 20000, fall: int = 10, edge: int = -75, gap: int = 45000) -> DataFrame:
    """Adds ``reason`` to the Wi-Fi readings after which the route is expected to leave, at most one each ``gap``: Wi-Fi is
    lost; it lost validation; its level fell by ``fall`` or more since the oldest of at least three readings within ``reach``;
    or it is at or below ``edge``. A loss starts anew; readings without a level, and those that report the lost validation,
    are not part of the fall. Readings of one time count together."""
    by = Window.partitionBy(*keys).orderBy(*order)
    rows = readings.withColumn("_epoch", F.sum(F.col(lost).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    was = F.when(~F.col(lost), F.lag(F.when(~F.col(lost), F.col(validated))).over(Window.partitionBy(*keys, "_epoch").orderBy(F.desc(lost), *order)))
    rows = rows.withColumn("_off", F.coalesce(was & ~F.col(validated), F.lit(False)))
    near = Window.partitionBy(*keys, "_epoch").orderBy(t).rangeBetween(-reach, 0)
    usable = F.when(~F.col(lost) & ~F.col("_off"), F.col(level))
    rows = rows.withColumn("_n", F.count(usable).over(near)).withColumn("_oldest", F.min_by(usable, F.when(usable.isNotNull(), F.struct(*order))).over(near))
    reason = F.when(F.col(lost), "wifi-lost").when(F.col("_off"), "wifi-lost-internet").when((F.col("_n") >= 3) & (F.col("_oldest") - usable >= fall), "wifi-falling").when(usable <= edge, "wifi-weak")
    told = rows.withColumn("reason", reason).where("reason is not null").drop("_epoch", "_off", "_n", "_oldest")
    return throttled(told, keys, t, order, gap)


def decay(readings: DataFrame, keys: list[str], t: str, level: str, reach: int = 20000, fall: int = 10, floor: int = -75) -> DataFrame:
    """Readings at or below ``floor``, or that fell by ``fall`` or more since the first of at least three within ``reach``."""
    by = Window.partitionBy(*keys).orderBy(t).rangeBetween(-reach, 0)
    rows = readings.withColumn("_n", F.count(level).over(by)).withColumn("_first", F.min_by(F.col(level), F.struct(F.col(t), F.col("id"))).over(by))
    return rows.where((F.col(level) <= floor) | (F.col("_n") >= 3) & (F.col("_first") - F.col(level) >= fall)).drop("_n", "_first")


def probe_health(probes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_cold, n_warm, cold_fail, warm_fail, p90_ms, verdict, contrast) of on-bearer probes marked cold.

    The verdict needs ten wake-ups. Their success is failing below 95 %: 'failing to wake' where being awake demonstrably
    helps (the intervals are apart) or was hardly measured, else 'failing'. Without a failure it is 'slow' or 'healthy' by the
    p90 of three or more successes, else 'occasional'. ``contrast``: warm probes do better than cold ones, intervals apart."""
    cold, fail = F.col("cold"), F.col("outcome") == "FAIL"
    out = probes.groupBy(*keys).agg(F.count_if(cold).alias("n_cold"), F.count_if(~cold).alias("n_warm"), F.count_if(cold & fail).alias("cold_fail"), F.count_if(~cold & fail).alias("warm_fail"))
    ok = weighted_hist(probes.where(cold & ~fail), keys, "latency_ms")
    out = out.join(percentiles(ok, keys, "latency_ms", "C", p90_ms=0.9), keys, "left")
    rate = lambda n, bad: F.try_divide(F.col(n) - F.col(bad), F.col(n))
    c, w = rate("n_cold", "cold_fail"), rate("n_warm", "warm_fail")
    ci, wi = wilson(F.coalesce(c, F.lit(0.0)), F.col("n_cold")), wilson(F.coalesce(w, F.lit(0.0)), F.col("n_warm"))
    apart = wi["lo"] > ci["hi"]
    slow = (F.col("n_cold") - F.col("cold_fail") >= 3) & (F.col("p90_ms") > 1500)
    verdict = F.when(F.col("n_cold") < 10, "too few").when(c < 0.95, F.when((F.col("n_warm") < 10) | apart, "failing to wake").otherwise("failing")).when(F.col("cold_fail") > 0, "occasional").when(slow, "slow").otherwise("healthy")
    contrast = (F.col("n_cold") >= 10) & (F.col("n_warm") >= 10) & (F.col("cold_fail") > 0) & F.coalesce(w > c, F.lit(False)) & apart
    return out.withColumn("verdict", verdict).withColumn("contrast", contrast)


def dominant_failure(rows: DataFrame, keys: list[str], signature: list[str]) -> DataFrame:
    """(keys, signature, n): the most frequent signature per key, ties to the least."""
    n = rows.groupBy(*keys, *signature).agg(F.count("*").alias("n"))
    by = Window.partitionBy(*keys).orderBy(F.desc("n"), *signature)
    return n.withColumn("_r", F.row_number().over(by)).where("_r = 1").drop("_r")


def last_n(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where(F.col("_r") <= n).drop("_r")


def tile_xy(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """The Web Mercator tile of a point."""
    n = 1 << zoom
    phi = F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat)))
    clamp = lambda v: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(v))).cast("int")
    return clamp((lng + 180) / 360 * n), clamp((1 - F.ln(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * n)


BOX_TILES, FINEST_TILE = 16, 14  # tiles that a box is cut into at most (twice as many along its edges), finest zoom


def _grid(v: Column, whole: float, offset: float, zoom: Column) -> Column:
    """The tile that a coordinate lies in, of 2 ** zoom over the whole range."""
    n = F.pow(F.lit(2.0), zoom)
    return F.greatest(F.lit(0), F.least(n - 1, F.floor((v + offset) / whole * n))).cast("long")


def locate_boxes(points: DataFrame, boxes: DataFrame, lat: str, lng: str) -> DataFrame:
    """Points with the first box (name, west, south, east, north, ordinal) that holds them, edges included; a box may cross the
    antimeridian. Each box is cut into the tiles of a quadtree of the zoom that suits its size, distinct points look up their tile
    of each zoom in use (``FINEST_TILE`` + 1 of them at most), an equality join, and the bounds decide. Points without a place
    get no name."""
    whole = boxes.where("west <= east").union(boxes.where("west > east").withColumn("east", F.lit(180.0))).union(boxes.where("west > east").withColumn("west", F.lit(-180.0)))
    side = F.greatest((F.col("east") - F.col("west")) / 360, (F.col("north") - F.col("south")) / 180)
    zoom = F.greatest(F.lit(0.0), F.least(F.lit(float(FINEST_TILE)), F.floor(-F.log2(F.greatest(side, F.lit(1e-9))) + math.log2(BOX_TILES) / 2))).cast("int")
    tiles = whole.withColumn("_z", zoom)
    for axis, low, high, size in (("_x", "west", "east", 360.0), ("_y", "south", "north", 180.0)):
        tiles = tiles.withColumn(axis, F.explode(F.sequence(_grid(F.col(low), size, size / 2, F.col("_z")), _grid(F.col(high), size, size / 2, F.col("_z")))))
    zooms = [r[0] for r in tiles.select("_z").distinct().collect()]  # 15 at most
    keys = points.where(F.col(lat).isNotNull() & F.col(lng).isNotNull()).select(lat, lng).distinct()
    at = keys.withColumn("_z", F.explode(F.array(*map(F.lit, zooms)) if zooms else F.array().cast("array<int>"))).withColumns({"_x": _grid(F.col(lng), 360.0, 180.0, F.col("_z")), "_y": _grid(F.col(lat), 180.0, 90.0, F.col("_z"))})
    met = at.join(tiles, ["_z", "_x", "_y"]).where(F.col(lat).between(F.col("south"), F.col("north")) & F.col(lng).between(F.col("west"), F.col("east")))
    return points.join(met.groupBy(lat, lng).agg(F.min_by("name", "ordinal").alias("name")), [lat, lng], "left")


def held(rows: DataFrame, keys: list[str], t: str, value: str, order: list[str], dwell: int) -> DataFrame:
    """(keys, value, start_ms, end_ms): runs of one value that last ``dwell`` or more."""
    by = Window.partitionBy(*keys).orderBy(*order)
    run = rows.withColumn("_new", (~F.col(value).eqNullSafe(F.lag(value).over(by)) | (F.row_number().over(by) == 1)).cast("int")).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*keys, value, "_run").agg(F.min(t).alias("start_ms"), F.max(t).alias("end_ms")).where(F.col("end_ms") - F.col("start_ms") >= dwell).drop("_run")


def confirmed(rows: DataFrame, keys: list[str], t: str, value: str, order: list[str], dwell: int) -> DataFrame:
    """(keys, value, since_ms, at_ms): where a value is confirmed, that is, still the same ``dwell`` or more after it came up;
    rows without a value are passed over, and one that is confirmed again without another in between is not told twice."""
    by = Window.partitionBy(*keys).orderBy(*order)
    known = rows.where(F.col(value).isNotNull())
    runs = _islands(known, keys, order, (F.col(value) != F.lag(value).over(by)) | (F.row_number().over(by) == 1))
    since = F.min(t).over(Window.partitionBy(*keys, "_island"))
    ripe = runs.withColumn("since_ms", since).where(F.col(t) - F.col("since_ms") >= dwell)
    first = ripe.groupBy(*keys, "_island", value, "since_ms").agg(F.min(t).alias("at_ms"))
    return changes_only(first, keys, [value], ["_island"]).select(*keys, value, "since_ms", "at_ms")


def grid_cell(lat: Column, lng: Column, degrees: float = 0.5) -> Column:
    """The name of a point's square of the grid."""
    return F.concat_ws("_", F.floor(lat / degrees), F.floor(lng / degrees))


def freshness(latest: DataFrame, as_of: Column) -> DataFrame:
    """Adds signal_stale, service_stale and cell_stale to (signal_ms, service_ms, cell_ms), the times of the last reports; what
    was never reported is stale."""
    stale = lambda c, limit: F.coalesce(as_of - F.col(c) > limit, F.lit(True))
    return latest.withColumns({f"{k}_stale": stale(f"{k}_ms", limit) for k, limit in STALE_MS.items()})


def fault_kind(cause: Column) -> Column:
    """What kind of fault the text of a cause tells."""
    u = F.upper(cause)
    return F.when(u.rlike("IPV6|RS_RA|SLAAC|PDP_ADDRESS|ADDRESS"), "IPV6_CONFIG_FAILURE").when(u.rlike("UNSPECIFIED|UNKNOWN"), "UNKNOWN").otherwise("REPEATED_SETUP_FAILURE")


def order_faults(faults: DataFrame, keys: list[str], as_of: Column, end: str = "end_ms", quiet: int = 900000, forget: int = 86400000) -> DataFrame:
    """Faults with ``active`` (none is after ``quiet`` without a failure) and their ``place`` per key: active ones first, then the
    latest; those quiet for longer than ``forget`` are left out."""
    told = faults.where(as_of - F.col(end) <= forget).withColumn("active", as_of - F.col(end) < quiet)
    return told.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("active"), F.desc(end))))
