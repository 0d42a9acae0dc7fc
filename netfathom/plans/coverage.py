"""Queries of bins, roll-ups and studies."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..functions import hexgrid, radio
from ..operators import bins, intervals, rollup, studies, timeline
from ..operators.lineage import cut
from .core import _CHANGES, _COLD, _FIXED, _FLIPS, _WEIGHTED, _cell_changes, _round, hex_sql, located, parent_sql
from .registry import query

_SAMPLES = _WEIGHTED + _FIXED + """, rt AS (SELECT r.id, max_by(l.transport, (l.elapsed_ms, l.id)) AS transport, max_by(l.validated, (l.elapsed_ms, l.id)) AS validated, max_by(l.not_suspended, (l.elapsed_ms, l.id)) AS not_suspended
  FROM radio r LEFT JOIN links l ON l.device_id = r.device_id AND l.wall_ms - l.elapsed_ms = r.wall_ms - r.elapsed_ms AND l.elapsed_ms <= r.elapsed_ms GROUP BY r.id),
samples AS (SELECT w.*, l.cell, l.speed, rt.transport, rt.validated, rt.not_suspended, lag(w.ci) OVER (PARTITION BY w.device_id, l.cell, w.sub_id ORDER BY w.wall_ms, w.id) AS ci_before
  FROM weighted w JOIN located l ON l.id = w.id JOIN rt ON rt.id = w.id WHERE l.cell IS NOT NULL),
leaves AS (SELECT cell, sub_id, count(*) AS n, CAST(sum(weight_ms) AS BIGINT) AS ms, CAST(sum(weight_ms * weight_ms) AS BIGINT) AS ms_sq, CAST(sum(CASE WHEN validated THEN weight_ms ELSE 0 END) AS BIGINT) AS validated_ms,
  CAST(sum(CASE WHEN NOT not_suspended THEN weight_ms ELSE 0 END) AS BIGINT) AS suspended_ms, CAST(sum(CASE WHEN transport = 'CELLULAR' THEN weight_ms ELSE 0 END) AS BIGINT) AS cell_route_ms,
  count(*) FILTER (transport = 'CELLULAR') AS cell_route_n, CAST(sum(CASE WHEN transport = 'CELLULAR' AND validated THEN weight_ms ELSE 0 END) AS BIGINT) AS cell_validated_ms, CAST(sum(CASE WHEN transport = 'WIFI' THEN weight_ms ELSE 0 END) AS BIGINT) AS wifi_ms,
  count(*) FILTER (ci <> ci_before) AS cell_changes, CAST(sum(CASE WHEN speed IS NOT NULL THEN weight_ms ELSE 0 END) AS BIGINT) AS speed_ms, sum(coalesce(speed, 0) * weight_ms) AS speed_mps_ms, CAST(sum(CASE WHEN rat = 'NR' THEN weight_ms ELSE 0 END) AS BIGINT) AS nr_ms FROM samples GROUP BY cell, sub_id)"""


_BIN = ["device_id", "cell", "sub_id"]


def _routed(spark: SparkSession, sf_dir: str, starts: DataFrame) -> DataFrame:
    """Radio rows with boots, weights and the route in force."""
    rows = timeline.time_weight(timeline.assign_boot(domain.radio(spark, sf_dir), starts), ["device_id", "sub_id", "boot"], order=["id"])
    links = timeline.assign_boot(domain.links(spark, sf_dir), starts).groupBy("device_id", "boot", "elapsed_ms").agg(F.max_by(F.struct("transport", "validated", "not_suspended"), "id").alias("x")).select("device_id", "boot", "elapsed_ms", "x.*")
    return timeline.asof_join(rows, links, ["device_id", "boot"], "elapsed_ms", ["transport", "validated", "not_suspended"])


def placed_on_map(spark: SparkSession, sf_dir: str, rows: DataFrame, starts: DataFrame, by_accuracy: bool = False) -> DataFrame:
    """Rows with boots that have a place, with it."""
    return located(spark, sf_dir, rows, starts, by_accuracy).where("cell is not null")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radio rows with boots, weights, routes, cells and changes, where they have a place."""
    starts = timeline.boot_starts([domain.events(spark, sf_dir)])
    return bins.cell_changes(placed_on_map(spark, sf_dir, _routed(spark, sf_dir, starts), starts), _BIN, "ci", ["wall_ms", "id"])


@query(_SAMPLES + " SELECT * REPLACE (round(speed_mps_ms, 4) AS speed_mps_ms) FROM leaves")
def bin_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.bin_leaves(samples(spark, sf_dir), ["cell", "sub_id"]).withColumn("speed_mps_ms", F.round("speed_mps_ms", 4))


@query(_SAMPLES + ", rk AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY ms DESC, n DESC, sub_id) AS r, CAST(sum(n) OVER (PARTITION BY cell) AS BIGINT) - n AS other_n FROM leaves) SELECT cell, sub_id, n, ms, other_n FROM rk WHERE r = 1")
def pick_subscription(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = bins.bin_leaves(samples(spark, sf_dir), ["cell", "sub_id"])
    return bins.pick_subscription(leaves, "cell", "sub_id").select("cell", "sub_id", "n", "ms", "other_n")


_PROBES = _COLD + _FIXED.replace("FROM radio\n", "FROM probes\n") + """, pb AS (SELECT l.cell, count(*) FILTER (c.net_id <> '') AS probe_n, count(*) FILTER (c.net_id <> '' AND c.outcome = 'FAIL') AS probe_fail, count(*) FILTER (c.net_id = '') AS no_bearer_n,
  count(*) FILTER (c.net_id <> '' AND c.cold) AS cold_n, count(*) FILTER (c.net_id <> '' AND c.cold AND c.outcome = 'FAIL') AS cold_fail FROM cold c JOIN located l ON l.id = c.id WHERE l.cell IS NOT NULL GROUP BY l.cell)"""


def _cold_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_bearer = F.col("net_id") != ""
    return timeline.mark_cold(domain.probes(spark, sf_dir), ["device_id"], on_bearer=on_bearer).withColumn("on_bearer", on_bearer)


def _located_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = timeline.boot_starts([domain.events(spark, sf_dir)])
    return placed_on_map(spark, sf_dir, timeline.assign_boot(_cold_probes(spark, sf_dir), starts), starts)


@query(_PROBES + " SELECT * FROM pb")
def probe_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.probe_bins(_located_probes(spark, sf_dir), ["cell"])


_OK = ", ok AS (SELECT l.cell, c.latency_ms AS latency_bin FROM cold c JOIN located l ON l.id = c.id WHERE l.cell IS NOT NULL AND c.net_id <> '' AND c.outcome = 'OK')"


@query(_PROBES + _OK + " SELECT cell, latency_bin, count(*) AS weight FROM ok GROUP BY ALL")
def probe_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.probe_latencies(_located_probes(spark, sf_dir), ["cell"])


_CLASSES = _SAMPLES + """, cb AS (SELECT cell, CAST(sum(n) AS BIGINT) AS n, sum(ms) AS ms, sum(suspended_ms) AS suspended_ms, sum(cell_route_ms) AS cell_route_ms, sum(cell_route_n) AS cell_route_n, sum(cell_validated_ms) AS cell_validated_ms, sum(cell_changes) AS cell_changes, sum(speed_ms) AS speed_ms, sum(speed_mps_ms) AS speed_mps_ms, sum(nr_ms) AS nr_ms FROM leaves GROUP BY cell),
ms AS (SELECT *, greatest(ms / 60000, 1.0 / 60) AS mins FROM cb),
mm AS (SELECT *, cell_changes / mins AS reselect_rate, CASE WHEN speed_ms > 0 THEN speed_mps_ms / speed_ms * 3.6 ELSE 0 END AS kph, CASE WHEN cell_route_ms > 0 THEN cell_validated_ms / cell_route_ms END AS cv FROM ms)
SELECT cell, n, round(reselect_rate, 5) AS reselect_rate, round(kph, 5) AS speed_kph, round(cv, 5) AS cell_validated, CASE WHEN n < 8 OR cell_route_n = 0 THEN 'UNSURVEYED' WHEN cv < 0.8 THEN 'ROUTE_LOSS' WHEN reselect_rate > 2 AND kph < 5 THEN 'RESELECT' WHEN nr_ms * 2 > ms THEN 'NSA' ELSE 'LTE' END AS outcome FROM mm"""


@query(_CLASSES)
def classify_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes by radio and route alone, without flaps and probes; ``coverage_map`` is the whole map."""
    whole = bins.combine(bins.bin_leaves(samples(spark, sf_dir), ["cell", "sub_id"]), ["cell"])
    none = {c: F.lit(0) for c in ("flaps", "probe_n", "probe_fail", "cold_n", "cold_fail")}
    out = bins.classify(bins.measures(whole.withColumns(none)))
    return out.select("cell", "n", *[F.round(c, 5).alias(c) for c in ("reselect_rate", "speed_kph", "cell_validated")], "outcome")


def _places_of(rows: str, mark: str, fixed: str = _FIXED) -> str:
    """The expressions that locate radio rows, for other rows, under names with a mark."""
    return re.sub(r"\b(fx|uni|pn|located)\b", rf"\1_{mark}", fixed.replace("FROM radio\n", f"FROM {rows}\n"))


_MAP = _SAMPLES + _COLD + _places_of("probes", "p") + """, pl AS (SELECT l.cell, c.* FROM cold c JOIN located_p l ON l.id = c.id WHERE l.cell IS NOT NULL),
pb AS (SELECT cell, count(*) FILTER (net_id <> '') AS probe_n, count(*) FILTER (net_id <> '' AND outcome = 'FAIL') AS probe_fail, count(*) FILTER (net_id <> '' AND cold) AS cold_n, count(*) FILTER (net_id <> '' AND cold AND outcome = 'FAIL') AS cold_fail,
  count(*) FILTER (net_id <> '' AND outcome = 'OK') AS ok_n, list_sort(list(latency_ms) FILTER (net_id <> '' AND outcome = 'OK')) AS oks FROM pl GROUP BY cell)""" + _FLIPS + _places_of("flips", "f") + """, fb AS (SELECT cell, count(*) AS flaps FROM located_f WHERE cell IS NOT NULL GROUP BY cell),
cb AS (SELECT cell, CAST(sum(n) AS BIGINT) AS n, sum(ms) AS ms, sum(cell_route_ms) AS cell_route_ms, sum(cell_route_n) AS cell_route_n, sum(cell_validated_ms) AS cell_validated_ms, sum(cell_changes) AS cell_changes, sum(speed_ms) AS speed_ms, sum(speed_mps_ms) AS speed_mps_ms, sum(nr_ms) AS nr_ms FROM leaves GROUP BY cell),
jn AS (SELECT cb.*, greatest(ms / 60000, 1.0 / 60) AS mins, coalesce(flaps, 0) AS flaps, coalesce(probe_n, 0) AS probe_n, coalesce(probe_fail, 0) AS probe_fail, coalesce(cold_n, 0) AS cold_n, coalesce(cold_fail, 0) AS cold_fail, coalesce(ok_n, 0) AS ok_n,
  oks[CAST(floor(0.9::DOUBLE * (ok_n - 1) + 0.5) AS BIGINT) + 1] AS p90_ms FROM cb LEFT JOIN pb ON pb.cell = cb.cell LEFT JOIN fb ON fb.cell = cb.cell),
mm AS (SELECT *, cell_changes / mins AS reselect_rate, CASE WHEN speed_ms > 0 THEN speed_mps_ms / speed_ms * 3.6 ELSE 0 END AS kph, CASE WHEN cell_route_ms > 0 THEN cell_validated_ms / cell_route_ms END AS cv, greatest(0, least(1, 1 - flaps / mins / 4)) AS anchor, CAST(probe_fail AS DOUBLE) / nullif(probe_n, 0) AS fr FROM jn),
wl AS (SELECT *, greatest(0, ((fr + 3.8416 / (2 * probe_n)) - 1.96 * sqrt(fr * (1 - fr) / probe_n + 3.8416 / (4.0 * probe_n * probe_n))) / (1 + 3.8416 / probe_n)) AS lo FROM mm)
SELECT cell, n, flaps, probe_n, probe_fail, cold_n, cold_fail, ok_n, p90_ms, round(anchor, 5) AS anchor, round(reselect_rate, 5) AS reselect_rate, round(kph, 5) AS speed_kph, round(cv, 5) AS cell_validated,
  CASE WHEN n < 8 OR cell_route_n + probe_n = 0 THEN 'UNSURVEYED' WHEN cv < 0.8 OR lo > 0.05 THEN 'ROUTE_LOSS' WHEN anchor < 0.6 THEN 'ANCHOR' WHEN reselect_rate > 2 AND kph < 5 THEN 'RESELECT'
    WHEN cold_n > 0 AND (cold_n - cold_fail) / cold_n < 0.95 OR fr > 1 - 0.95::DOUBLE OR ok_n >= 3 AND p90_ms > 1500 THEN 'SLOW' WHEN nr_ms * 2 > ms THEN 'NSA' ELSE 'LTE' END AS outcome FROM wl"""


def map_rows(spark: SparkSession, sf_dir: str, by_accuracy: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The samples, probes and route flips that have a place, located together in one pass over the fixes and kept."""
    starts = timeline.boot_starts([domain.events(spark, sf_dir)])
    found = {"probe": timeline.assign_boot(_cold_probes(spark, sf_dir), starts)}
    found["flip"] = intervals.value_changes(timeline.assign_boot(domain.links(spark, sf_dir), starts), ["device_id", "boot"], "transport", ["elapsed_ms", "id"])
    rows = _routed(spark, sf_dir, starts).withColumn("kind", F.lit("sample"))
    for kind, more in found.items():
        rows = rows.unionByName(more.withColumn("kind", F.lit(kind)), allowMissingColumns=True)
    placed = cut(placed_on_map(spark, sf_dir, rows, starts, by_accuracy))
    samples, probes, flips = (placed.where(F.col("kind") == k) for k in ("sample", "probe", "flip"))
    return bins.cell_changes(samples, _BIN, "ci", ["wall_ms", "id"]), probes, flips


def flaps_of(flips: DataFrame) -> DataFrame:
    """(cell, flaps) of located flips of the route."""
    return flips.groupBy("cell").agg(F.count("*").alias("flaps"))


@query(_MAP)
def coverage_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome classes of all bins by the radio, the probes and the flaps of the route in them."""
    rows, probes, flips = map_rows(spark, sf_dir)
    whole = bins.combine(bins.bin_leaves(rows, ["cell", "sub_id"]), ["cell"])
    for bin_ in (bins.probe_bins(probes, ["cell"]), bins.latency_p90(bins.probe_latencies(probes, ["cell"]), ["cell"]), flaps_of(flips)):
        whole = whole.join(bin_, "cell", "left")
    out = bins.classify(bins.measures(whole))
    counts = ["flaps", "probe_n", "probe_fail", "cold_n", "cold_fail", "ok_n", "p90_ms"]
    return out.select("cell", "n", *counts, *[F.round(c, 5).alias(c) for c in ("anchor", "reselect_rate", "speed_kph", "cell_validated")], "outcome")


# ---- roll-ups -------------------------------------------------------------------------------------------------------------

_HOURLY = """, ex AS (SELECT *, 1000 * wall_ms AS t FROM radio), hourly AS (SELECT t - t % 3600000 AS hour, sub_id, plmn, rat, band, ci, count(*) AS n, bit_or(CAST(1 AS BIGINT) << CAST(t % 3600000 // 60000 AS BIGINT)) AS mask,
  min(t) AS first_ms, max(t) AS last_ms, count(*) FILTER (sinr < 0) AS below FROM ex GROUP BY ALL)"""
_HOUR_KEYS = ["sub_id", "plmn", "rat", "band", "ci"]


def _hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.radio(spark, sf_dir).withColumn("t", F.col("wall_ms") * 1000)
    return rollup.compact_hour(rows, _HOUR_KEYS, "t", {"below": (F.col("sinr") < 0).cast("long")})


@query(_HOURLY + " SELECT *, bit_count(mask) AS minutes FROM hourly")
def compact_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hourly(spark, sf_dir)


@query(_HOURLY + " SELECT hour, rat, band, CAST(sum(n) AS BIGINT) AS n, bit_or(mask) AS mask, min(first_ms) AS first_ms, max(last_ms) AS last_ms, CAST(sum(below) AS BIGINT) AS below, bit_count(bit_or(mask)) AS minutes FROM hourly GROUP BY hour, rat, band")
def merge_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.merge_buckets(_hourly(spark, sf_dir), ["rat", "band"], ["below"])


@query(_HOURLY + " SELECT hour - hour % 86400000 AS day, sub_id, plmn, rat, band, CAST(sum(n) AS BIGINT) AS n, count(*) AS buckets, count(DISTINCT hour) AS hours, count(DISTINCT ci) AS cells, CAST(sum(below) AS BIGINT) AS below FROM hourly GROUP BY ALL")
def roll_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.roll_day(_hourly(spark, sf_dir), ["sub_id", "plmn", "rat", "band"], ["ci"], ["below"])


@query(""", inv AS (SELECT 1000 * wall_ms - 1000 * wall_ms % 86400000 AS day, count(*) * 100 AS bytes FROM e GROUP BY 1),
s AS (SELECT *, (2592000000 - day) // 86400000 AS age, sum(bytes) OVER (ORDER BY day DESC) AS newer FROM inv)
SELECT day, bytes, CASE WHEN age > 30 OR (newer > (SELECT sum(bytes) FROM inv) / 2 AND age >= 7) THEN 'compact' ELSE 'keep' END AS action FROM s""")
def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("wall_ms") * 1000
    inventory = domain.events(spark, sf_dir).groupBy((t - t % 86400000).alias("day")).agg((F.count("*") * 100).alias("bytes"))
    return rollup.retention_plan(inventory, 2592000000, inventory.agg((F.sum("bytes") / 2).alias("budget"))).select("day", "bytes", "action")


# ---- studies ----------------------------------------------------------------------------------------------------------------


def _pingpong(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = intervals.local_count(_cell_changes(spark, sf_dir), ["device_id", "sub_id"], "wall_ms", 120000, "churn")
    return studies.mark_pingpong(changes.select("device_id", "sub_id", "id", "wall_ms", "before", "ci", "churn"), ["device_id", "sub_id"], "wall_ms", "before", "ci", ["wall_ms", "id"])


#: Along the changes of a subscription, ``held`` are the departures of the last 30 s that nothing has closed.
_RETURNS = _CHANGES + """, pc AS (SELECT device_id, sub_id, id, wall_ms AS t, before, ci, count(*) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms RANGE BETWEEN 120000 PRECEDING AND 120000 FOLLOWING) AS churn,
  row_number() OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id) AS k FROM ch),
wk AS (SELECT device_id, sub_id, k, id, false AS is_return, [{'t': t, 'o': before}] AS held FROM pc WHERE k = 1
  UNION ALL SELECT pc.device_id, pc.sub_id, pc.k, pc.id, len(list_filter(held, lambda h: pc.t - h.t <= 30000 AND h.o = pc.ci)) > 0,
    list_concat(list_filter(held, lambda h: pc.t - h.t <= 30000 AND h.o <> pc.ci), CASE WHEN len(list_filter(held, lambda h: pc.t - h.t <= 30000 AND h.o = pc.ci)) > 0 THEN [] ELSE [{'t': pc.t, 'o': pc.before}] END)
    FROM wk JOIN pc ON pc.device_id = wk.device_id AND pc.sub_id = wk.sub_id AND pc.k = wk.k + 1),
pp AS (SELECT pc.*, wk.is_return, wk.is_return OR EXISTS (SELECT 1 FROM pc n WHERE n.device_id = pc.device_id AND n.sub_id = pc.sub_id AND n.k > pc.k AND n.t <= pc.t + 30000 AND n.ci = pc.before) AS pingpong FROM pc JOIN wk ON wk.id = pc.id)"""


@query(_RETURNS + " SELECT id, churn, pingpong, is_return FROM pp")
def mark_pingpong(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pingpong(spark, sf_dir).select("id", "churn", "pingpong", "is_return")


def _level_sql() -> str:
    """The first level with a free control: the case's own, else 1 below, 1 above, and so on."""
    count = lambda name, at: f"len(list_filter({name}, lambda v: v = {at}))"
    return "CASE " + " ".join(f"WHEN {count('taken', f'c.churn + {d}')} < {count('c.free', f'c.churn + {d}')} THEN c.churn + {d}" for d in (0, -1, 1, -2, 2)) + " END"


_MATCHED = _RETURNS + f""", ctl AS (SELECT *, row_number() OVER (PARTITION BY device_id, sub_id, churn ORDER BY t, id) AS rank FROM pp WHERE NOT is_return AND NOT pingpong),
fr AS (SELECT device_id, sub_id, list(churn) AS free FROM ctl GROUP BY ALL),
cs AS (SELECT pp.device_id, pp.sub_id, pp.id, churn, free, row_number() OVER (PARTITION BY pp.device_id, pp.sub_id ORDER BY t, pp.id) AS k FROM pp JOIN fr ON fr.device_id = pp.device_id AND fr.sub_id = pp.sub_id WHERE pingpong AND NOT is_return),
tk AS (SELECT device_id, sub_id, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS level, CAST([] AS BIGINT[]) AS taken FROM fr
  UNION ALL SELECT device_id, sub_id, k, id, level, CASE WHEN level IS NULL THEN taken ELSE list_append(taken, level) END FROM (SELECT c.device_id, c.sub_id, c.k, c.id, {_level_sql()} AS level, taken FROM tk JOIN cs c ON c.device_id = tk.device_id AND c.sub_id = tk.sub_id AND c.k = tk.k + 1) x),
pairs AS (SELECT tk.device_id, tk.sub_id, tk.id AS case_id, ctl.id AS control_id FROM tk JOIN ctl ON ctl.device_id = tk.device_id AND ctl.sub_id = tk.sub_id AND ctl.churn = tk.level AND ctl.rank = len(list_filter(taken, lambda v: v = tk.level)))"""


@query(_MATCHED + " SELECT * FROM pairs")
def match_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.match_controls(_pingpong(spark, sf_dir).where("not is_return"), ["device_id", "sub_id"], "id", "churn", "pingpong", ["wall_ms", "id"])


@query(""", x AS (SELECT *, CASE WHEN lag(outcome) OVER w <> outcome AND wall_ms - lag(wall_ms) OVER w <= 60000 THEN 0 ELSE 1 END AS f FROM probes WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY device_id, k ORDER BY wall_ms, id) AS rn, lead(id) OVER (PARTITION BY device_id, k ORDER BY wall_ms, id) AS second_id FROM y)
SELECT device_id, id AS first_id, second_id FROM z WHERE rn % 2 = 1 AND second_id IS NOT NULL""")
def pair_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return studies.pair_transfers(domain.probes(spark, sf_dir), ["device_id"], "wall_ms", "outcome", ["wall_ms", "id"])


_SITES = """, sh AS (SELECT plmn, ci // 256 AS enb, band, wall_ms // 3600 % 24 AS hour, count(*) AS samples, count(*) FILTER (sinr < 0) AS below, max(wall_ms // 86400000) AS last_day FROM radio WHERE rat = 'LTE' GROUP BY ALL)"""


def _site_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = domain.radio(spark, sf_dir).withColumn("enb", radio.enb(F.col("rat"), F.col("ci"))).where("enb is not null")
    return studies.site_hours(r, ["plmn", "enb", "band"], F.floor(F.col("wall_ms") / 3600) % 24)


@query(_SITES + " SELECT * FROM sh")
def site_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _site_hours(spark, sf_dir)


@query(_SITES + """, sp AS (SELECT plmn, enb, band, (hour + d + 24) % 24 AS hour, samples, below FROM sh, (VALUES (-2), (-1), (0), (1), (2)) v(d)),
g AS (SELECT plmn, enb, band, hour, CAST(sum(samples) AS BIGINT) AS samples, sum(below) AS below FROM sp GROUP BY ALL)
SELECT plmn, enb, band, hour, samples, round(CAST(below AS DOUBLE) / samples, 6) AS share, CASE WHEN samples < 80 THEN 'unknown' WHEN CAST(below AS DOUBLE) / samples >= 0.25 THEN 'bad' ELSE 'good' END AS verdict FROM g""")
def site_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(studies.circular_verdict(_site_hours(spark, sf_dir), ["plmn", "enb", "band"]), "share")


_AREA = ", fc AS (SELECT device_id, wall_ms, max_by(" + parent_sql(hex_sql("lat", "lng", 9), 9) + """, id) AS cell FROM fixes GROUP BY device_id, wall_ms),
bh AS (SELECT f.cell, r.wall_ms // 3600 % 24 AS hour, count(*) AS samples, count(*) FILTER (r.sinr < 0) AS below, max(r.wall_ms // 86400000) AS last_day
  FROM radio r ASOF JOIN fc f ON f.device_id = r.device_id AND f.wall_ms <= r.wall_ms WHERE r.wall_ms - f.wall_ms <= 60000 GROUP BY ALL)"""


def _bin_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the area (resolution 8) of the latest fix, which is a minute old at most."""
    f = hexgrid.with_cell(domain.fixes(spark, sf_dir), "_c", F.col("lat"), F.col("lng"), 9).withColumn("cell", hexgrid.parent(F.col("_c"), 8))
    f = f.groupBy("device_id", "wall_ms").agg(F.max_by("cell", "id").alias("cell"))
    placed = timeline.asof_join(domain.radio(spark, sf_dir), f, ["device_id"], "wall_ms", ["cell"], max_age=60000).where("cell is not null")
    return studies.site_hours(placed, ["cell"], F.floor(F.col("wall_ms") / 3600) % 24)


@query(_AREA + " SELECT * FROM bh")
def bin_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bin_hours(spark, sf_dir)


def _around() -> str:
    move = lambda a, b: f"({hexgrid.TAG + (8 << 56)} + ((q + {a} + 268435456) % 268435456) * 268435456 + ((r + {b} + 268435456) % 268435456))"
    return "[" + ", ".join(move(a, b) for a, b in [*hexgrid.NEIGHBOURS, (0, 0)]) + "]"


@query(_AREA + f""", pq AS (SELECT cell, hour, ((cell - {hexgrid.TAG + (8 << 56)}) // 268435456 + 134217728) % 268435456 - 134217728 AS q, ((cell - {hexgrid.TAG + (8 << 56)}) % 268435456 + 134217728) % 268435456 - 134217728 AS r FROM bh),
ar AS (SELECT cell, hour, unnest({_around()}) AS c FROM pq)
SELECT ar.cell, ar.hour, coalesce(bool_or(bh.below * 4 >= bh.samples) FILTER (ar.c = ar.cell AND bh.samples >= 5), false) AS bad_here, coalesce(bool_or(bh.below * 4 >= bh.samples) FILTER (ar.c <> ar.cell AND bh.samples >= 5), false) AND NOT coalesce(bool_or(bh.below * 4 >= bh.samples) FILTER (ar.c = ar.cell AND bh.samples >= 5), false) AS bad_ahead
FROM ar LEFT JOIN bh ON bh.cell = ar.c AND bh.hour = ar.hour GROUP BY ar.cell, ar.hour""")
def area_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = _bin_hours(spark, sf_dir)
    return studies.lookahead(hours.select("cell", "hour"), hours, "cell", hexgrid.neighbours(F.col("cell")), least=5, bad=0.25)
