"""Queries of the map's derived measures, contributions, sessions and places."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..functions import hexgrid, radio
from ..operators import bins, devices, intervals, maps, studies, timeline
from ..operators.lineage import cut
from ..sources import tables
from .core import _CHANGES, _COLD, _FLIPS, _WEIGHTED, _cell_changes, _round, _weighted, feature_sql, hex_sql, parent_sql
from .coverage import _AREA, _MAP, _SAMPLES, _SITES, _around, _bin_hours, _places_of, _site_hours, flaps_of, map_rows, placed_on_map, samples
from .registry import query
from .signals import _TYPED, typed_probes

LABEL = "CASE WHEN rat = 'LTE' THEN 'B' ELSE 'n' END || CAST(band AS VARCHAR)"


def with_label(rows: DataFrame) -> DataFrame:
    return rows.withColumn("band_label", radio.band_label(F.col("rat"), F.col("band")))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_label(samples(spark, sf_dir))


@query(_SAMPLES + f""", lb AS (SELECT *, {LABEL} AS band_label FROM samples), un AS (SELECT cell, 'rsrp' AS measure, CAST(rsrp AS VARCHAR) AS value, weight_ms AS w FROM lb UNION ALL SELECT cell, 'sinr', CAST(sinr AS VARCHAR), weight_ms FROM lb
  UNION ALL SELECT cell, 'rat', rat, weight_ms FROM lb UNION ALL SELECT cell, 'band', band_label, weight_ms FROM lb UNION ALL SELECT cell, 'plmn', plmn, weight_ms FROM lb) SELECT cell, measure, value, CAST(sum(w) AS BIGINT) AS weight FROM un GROUP BY ALL""")
def bin_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.bin_histograms(labelled(spark, sf_dir), ["cell"], {"rsrp": "rsrp", "sinr": "sinr", "rat": "rat", "band": "band_label", "plmn": "plmn"})


@query(_SAMPLES + f", lb AS (SELECT *, {LABEL} AS band_label FROM samples) SELECT cell, band_label, 'rsrp' AS measure, CAST(rsrp AS VARCHAR) AS value, CAST(sum(weight_ms) AS BIGINT) AS weight FROM lb GROUP BY ALL")
def band_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.bin_histograms(labelled(spark, sf_dir), ["cell", "band_label"], {"rsrp": "rsrp"})


@query(_SAMPLES + " SELECT cell, count(DISTINCT device_id) AS contributors, min(wall_ms) AS first_ms, max(wall_ms) AS last_ms FROM samples GROUP BY cell")
def bin_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.bin_extent(samples(spark, sf_dir), ["cell"])


@query(_SAMPLES + ", cs AS (SELECT cell, rat, ci, band, count(*) AS samples, CAST(sum(weight_ms) AS BIGINT) AS ms FROM samples GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY cell ORDER BY ms DESC, samples DESC, rat, ci, band) AS INT) AS place FROM cs")
def cell_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.cell_shares(samples(spark, sf_dir), ["cell"], ["rat", "ci", "band"])


@query(_SAMPLES + """ SELECT cell, sub_id, n, ms, validated_ms, cell_changes FROM leaves""")
def merge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of two halves of the devices, as restored and live ones, merged: as if they had been built at once."""
    rows = samples(spark, sf_dir)
    halves = [bins.bin_leaves(rows.where(F.col("device_id") % 2 == k), ["cell", "sub_id"]) for k in (0, 1)]
    return bins.combine(halves[0].unionByName(halves[1]), ["cell", "sub_id"]).select("cell", "sub_id", "n", "ms", "validated_ms", "cell_changes")


@query(_FLIPS + _places_of("flips", "f") + " SELECT cell, count(*) AS flaps FROM located_f WHERE cell IS NOT NULL GROUP BY cell")
def located_flaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = timeline.boot_starts([domain.events(spark, sf_dir)])
    flips = intervals.value_changes(timeline.assign_boot(domain.links(spark, sf_dir), starts), ["device_id", "boot"], "transport", ["elapsed_ms", "id"])
    return flaps_of(placed_on_map(spark, sf_dir, flips, starts))


_ALL = _MAP[: _MAP.index("\nSELECT cell, n, flaps")] + f""",
cls AS (SELECT *, CASE WHEN n < 8 OR cell_route_n + probe_n = 0 THEN 'UNSURVEYED' WHEN cv < 0.8 OR lo > 0.05 THEN 'ROUTE_LOSS' WHEN anchor < 0.6 THEN 'ANCHOR' WHEN reselect_rate > 2 AND kph < 5 THEN 'RESELECT'
    WHEN cold_n > 0 AND (cold_n - cold_fail) / cold_n < 0.95 OR fr > 1 - 0.95::DOUBLE OR ok_n >= 3 AND p90_ms > 1500 THEN 'SLOW' WHEN nr_ms * 2 > ms THEN 'NSA' ELSE 'LTE' END AS outcome FROM wl),
lb AS (SELECT *, {LABEL} AS band_label FROM samples),
ex AS (SELECT cell, CAST(sum(weight_ms * weight_ms) AS DOUBLE) AS sq, CAST(sum(CASE WHEN validated THEN weight_ms ELSE 0 END) AS BIGINT) AS vms, CAST(sum(CASE WHEN NOT not_suspended THEN weight_ms ELSE 0 END) AS BIGINT) AS sms, CAST(sum(CASE WHEN transport = 'WIFI' THEN weight_ms ELSE 0 END) AS BIGINT) AS wms,
  count(DISTINCT device_id) AS contributors, min(wall_ms) AS first_ms, max(wall_ms) AS last_ms, count(DISTINCT CASE WHEN rat = 'LTE' THEN ci // 256 END) AS masts FROM lb GROUP BY cell),
rh AS (SELECT cell, rsrp AS v, sum(weight_ms) AS w FROM lb GROUP BY ALL HAVING sum(weight_ms) > 0), rc AS (SELECT *, sum(w) OVER (PARTITION BY cell ORDER BY v) AS run, sum(w) OVER (PARTITION BY cell) AS t FROM rh), rp AS (SELECT cell, min(v) AS rsrp_p50 FROM rc WHERE run >= 0.5::DOUBLE * t GROUP BY cell),
sh2 AS (SELECT cell, sinr AS v, sum(weight_ms) AS w FROM lb GROUP BY ALL HAVING sum(weight_ms) > 0), sc AS (SELECT *, sum(w) OVER (PARTITION BY cell ORDER BY v) AS run, sum(w) OVER (PARTITION BY cell) AS t FROM sh2), spc AS (SELECT cell, min(v) AS sinr_p50 FROM sc WHERE run >= 0.5::DOUBLE * t GROUP BY cell),
dr AS (SELECT cell, arg_min(rat, (-w, rat)) AS rat FROM (SELECT cell, rat, sum(weight_ms) AS w FROM lb GROUP BY ALL HAVING sum(weight_ms) > 0) x GROUP BY cell), db AS (SELECT cell, arg_min(band_label, (-w, band_label)) AS band_label FROM (SELECT cell, band_label, sum(weight_ms) AS w FROM lb GROUP BY ALL HAVING sum(weight_ms) > 0) x GROUP BY cell),
dp AS (SELECT cell, arg_min(plmn, (-w, plmn)) AS plmn FROM (SELECT cell, plmn, sum(weight_ms) AS w FROM lb GROUP BY ALL HAVING sum(weight_ms) > 0) x GROUP BY cell),
mb AS (SELECT cls.*, sq, vms, sms, wms, contributors, first_ms, last_ms, masts, rsrp_p50, sinr_p50, dr.rat, band_label, plmn, CASE WHEN cold_n > 0 THEN CAST(cold_n - cold_fail AS DOUBLE) / cold_n END AS cs, coalesce(CAST(sms AS DOUBLE) / nullif(ms, 0), 0) AS susp FROM cls JOIN ex USING (cell) LEFT JOIN rp USING (cell) LEFT JOIN spc USING (cell) LEFT JOIN dr USING (cell) LEFT JOIN db USING (cell) LEFT JOIN dp USING (cell)),
mc AS (SELECT *, CASE WHEN cell_route_n = 0 AND probe_n = 0 THEN 0 WHEN susp > 0.1::DOUBLE THEN 5 WHEN cv < 0.8 THEN CASE WHEN coalesce(rsrp_p50, 0) < -115 THEN 1 ELSE 6 END WHEN probe_fail > 0 THEN 6 WHEN reselect_rate > 2 AND kph < 5 THEN 3 WHEN flaps > 0 AND wms * 2 > ms THEN 7 ELSE 0 END AS cause FROM mb)"""


def whole(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Classified bins with all measures, and the samples they are made of."""
    rows, probes, flips = map_rows(spark, sf_dir)
    rows = cut(with_label(rows))  # ten aggregates read them
    out = bins.combine(bins.bin_leaves(rows, ["cell", "sub_id"]), ["cell"])
    for more in (bins.probe_bins(probes, ["cell"]), bins.latency_p90(bins.probe_latencies(probes, ["cell"]), ["cell"]), flaps_of(flips)):
        out = out.join(more, "cell", "left")
    out = maps.bin_measures(bins.classify(bins.measures(out)), rows, ["cell"])
    return out.withColumn("cause", maps.cause()), rows


def _ci(p: str, n: str, sign: str) -> str:
    part = f"((coalesce({p}, 0) + 3.8416::DOUBLE / (2 * {n}) {sign} 1.96::DOUBLE * sqrt(coalesce({p}, 0) * (1 - coalesce({p}, 0)) / {n} + 3.8416::DOUBLE / (4.0 * {n} * {n}))) / (1 + 3.8416::DOUBLE / {n}))"
    return f"CASE WHEN {n} > 0 THEN {'least(1, ' if sign == '+' else 'greatest(0, '}{part}) ELSE {1 if sign == '+' else 0} END"


_NAMES = ["cell", "n", "rsrp_p50", "sinr_p50", "rat", "band_label", "plmn", "masts", "contributors", "first_ms", "last_ms", "effective_n", "validated", "suspended", "fail_lo", "fail_hi", "cold_lo", "cold_hi", "publishable", "cause"]


@query(_ALL + f""" SELECT cell, n, rsrp_p50, sinr_p50, rat, band_label, plmn, masts, contributors, first_ms, last_ms, CAST(CASE WHEN ms > 0 AND sq > 0 THEN floor(CAST(ms AS DOUBLE) * ms / sq) ELSE 0 END AS BIGINT) AS effective_n, round(coalesce(CAST(vms AS DOUBLE) / nullif(ms, 0), 0), 5) AS validated, round(susp, 5) AS suspended,
  round({_ci('fr', 'probe_n', '-')}, 5) AS fail_lo, round({_ci('fr', 'probe_n', '+')}, 5) AS fail_hi, round({_ci('cs', 'cold_n', '-')}, 5) AS cold_lo, round({_ci('cs', 'cold_n', '+')}, 5) AS cold_hi, contributors >= 5 AND n >= 30 AS publishable, cause FROM mc""")
def bin_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = whole(spark, sf_dir)
    shares = ("validated", "suspended", "fail_lo", "fail_hi", "cold_lo", "cold_hi")
    return out.select(*[F.round(c, 5).alias(c) if c in shares else c for c in _NAMES])


@query(_ALL + """, pb2 AS (SELECT rsrp AS v, sum(weight_ms) AS w FROM lb WHERE cell IN (SELECT cell FROM mc WHERE outcome = 'ROUTE_LOSS') GROUP BY 1 HAVING sum(weight_ms) > 0), pc2 AS (SELECT *, sum(w) OVER (ORDER BY v) AS run, sum(w) OVER () AS t FROM pb2)
SELECT count(*) AS bins, count(*) FILTER (outcome <> 'UNSURVEYED') AS surveyed, count(*) FILTER (outcome = 'UNSURVEYED') AS thin, count(*) FILTER (outcome = 'ROUTE_LOSS') AS bad, count(*) FILTER (outcome = 'ROUTE_LOSS' AND rsrp_p50 >= -98) AS bad_full_bars, count(*) FILTER (outcome = 'ROUTE_LOSS' AND rsrp_p50 < -108) AS bad_weak,
  count(*) FILTER (n >= 8 AND cell_route_n = 0 AND probe_n = 0) AS not_measured, CAST(sum(cold_n) AS BIGINT) AS cold_n, CAST(sum(cold_fail) AS BIGINT) AS cold_fail, (SELECT min(v) FROM pc2 WHERE run >= 0.5::DOUBLE * t) AS median_bad_rsrp FROM mc""")
def map_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.map_summary(*whole(spark, sf_dir), ["cell"])


_COLOURS = """CASE WHEN rsrp_p50 IS NULL THEN '#2a3240' WHEN rsrp_p50 >= -98 THEN '#1f9e5a' WHEN rsrp_p50 >= -108 THEN '#69b53a' WHEN rsrp_p50 >= -118 THEN '#d8b32e' WHEN rsrp_p50 >= -128 THEN '#c0562b' ELSE '#8e2f28' END AS rsrp_colour,
  CASE WHEN sinr_p50 IS NULL THEN '#2a3240' WHEN sinr_p50 >= 20 THEN '#2f9e6b' WHEN sinr_p50 >= 13 THEN '#46b07a' WHEN sinr_p50 >= 5 THEN '#b8862f' WHEN sinr_p50 >= 0 THEN '#a8642c' ELSE '#b03a42' END AS sinr_colour,
  CASE WHEN anchor >= 0.95 THEN '#2f9e6b' WHEN anchor >= 0.88 THEN '#5aa85a' WHEN anchor >= 0.75 THEN '#cfa338' WHEN anchor >= 0.55 THEN '#a8642c' ELSE '#b03a42' END AS anchor_colour"""
_PROPERTIES = ["plmn", "outcome", "n", "opacity", "rsrp_colour", "sinr_colour", "anchor_colour"]


@query(_ALL + f""" SELECT cell, round(CASE WHEN outcome = 'UNSURVEYED' THEN 0.3::DOUBLE ELSE 0.34::DOUBLE + 0.46::DOUBLE * least(1, greatest(0, (log10(greatest(n, 1)) - 0.9::DOUBLE) / 2.3::DOUBLE)) END, 5) AS opacity,
  {_COLOURS} FROM mc""")
def layer_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(maps.layer_style(whole(spark, sf_dir)[0]).select("cell", "opacity", "rsrp_colour", "sinr_colour", "anchor_colour").withColumn("opacity", F.round("opacity", 5)), "opacity")


@query(_ALL + f""", mf AS (SELECT *, round(CASE WHEN outcome = 'UNSURVEYED' THEN 0.3::DOUBLE ELSE 0.34::DOUBLE + 0.46::DOUBLE * least(1, greatest(0, (log10(greatest(n, 1)) - 0.9::DOUBLE) / 2.3::DOUBLE)) END, 5) AS opacity, {_COLOURS} FROM mc)
  SELECT {feature_sql('cell', 9, {c: c in ('n', 'opacity') for c in _PROPERTIES})} AS feature FROM mf""")
def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bins of the map as GeoJSON features with their colours and opacity."""
    styled = maps.layer_style(whole(spark, sf_dir)[0])
    return tables.to_geojson(styled.withColumn("opacity", F.round("opacity", 5)), "cell", _PROPERTIES)


@query(_ALL + """, bh2 AS (SELECT band_label, CAST(sum(weight_ms) AS BIGINT) AS ms FROM lb GROUP BY 1) SELECT band_label, ms, round(CAST(ms AS DOUBLE) / (SELECT sum(ms) FROM bh2), 6) AS share, (SELECT CAST(sum(probe_n) AS BIGINT) FROM mc) AS probe_n, (SELECT CAST(sum(probe_fail) AS BIGINT) FROM mc) AS probe_fail, (SELECT count(DISTINCT CASE WHEN rat = 'LTE' THEN ci // 256 END) FROM lb) AS masts, (SELECT count(DISTINCT ci) FROM lb) AS cells,
  (SELECT count(*) FROM mc WHERE anchor < 0.75) AS unstable_bins, (SELECT arg_min(cell, (anchor, cell)) FROM mc WHERE n >= 8) AS worst_bin FROM bh2""")
def layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per band its time and share, beside the pooled probes, masts, cells, unstable bins and the least stable bin of the map."""
    out, rows = whole(spark, sf_dir)
    bands = rows.groupBy("band_label").agg(F.sum("weight_ms").alias("ms"))
    total = bands.agg(F.sum("ms").alias("_t"))
    pooled = out.agg(F.sum("probe_n").alias("probe_n"), F.sum("probe_fail").alias("probe_fail"), F.count_if(F.col("anchor") < 0.75).alias("unstable_bins"), F.min(F.when(F.col("n") >= 8, F.struct("anchor", "cell")))["cell"].alias("worst_bin"))
    counts = rows.agg(F.countDistinct(radio.enb(F.col("rat"), F.col("ci"))).alias("masts"), F.countDistinct("ci").alias("cells"))
    one = total.crossJoin(pooled).crossJoin(counts)  # one row each
    return _round(bands.crossJoin(F.broadcast(one)).withColumn("share", F.col("ms") / F.col("_t")).drop("_t"), "share")


@query(_ALL + " SELECT cell, n, outcome FROM mc ORDER BY n DESC, cell")
def order_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whole(spark, sf_dir)[0].select("cell", "n", "outcome").orderBy(F.desc("n"), "cell")


_PTS = f", pp AS (SELECT *, CAST(1.25 AS DOUBLE) + device_id % 9 * CAST(0.0006 AS DOUBLE) + id % 5 * CAST(0.0005 AS DOUBLE) AS lat, CAST(103.6 AS DOUBLE) + device_id % 7 * CAST(0.0006 AS DOUBLE) + id % 3 * CAST(0.0005 AS DOUBLE) AS lng, 10 + id % 350 AS acc FROM radio)"


@query(_PTS + f""", lv AS (SELECT plmn, id, CASE WHEN acc / cos(radians(1.25)) <= 40 THEN {hex_sql('lat', 'lng', 10)} WHEN acc / cos(radians(1.25)) <= 120 THEN {hex_sql('lat', 'lng', 9)} WHEN acc / cos(radians(1.25)) <= 300 THEN {hex_sql('lat', 'lng', 8)} END AS cell,
  CASE WHEN acc / cos(radians(1.25)) <= 40 THEN 10 WHEN acc / cos(radians(1.25)) <= 120 THEN 9 WHEN acc / cos(radians(1.25)) <= 300 THEN 8 END AS res, 1000 + id % 7000 AS w FROM pp),
lf AS (SELECT cell, plmn, res, count(*) AS n, sum(w) AS ms FROM lv WHERE cell IS NOT NULL GROUP BY ALL), l9 AS (SELECT *, CASE WHEN res = 10 THEN {parent_sql('cell', 10)} WHEN res = 9 THEN cell END AS p9 FROM lf), l8 AS (SELECT *, CASE WHEN res = 8 THEN cell ELSE {parent_sql('p9', 9)} END AS p8 FROM l9),
ho AS (SELECT l8.*, CASE WHEN a.cell IS NOT NULL THEN a.cell WHEN b.cell IS NOT NULL THEN b.cell ELSE l8.cell END AS host, CASE WHEN a.cell IS NOT NULL THEN 49 WHEN b.cell IS NOT NULL THEN 7 ELSE CAST(pow(7, 10 - l8.res) AS BIGINT) END AS most FROM l8 LEFT JOIN lf a ON a.cell = p8 AND a.plmn = l8.plmn LEFT JOIN lf b ON b.cell = p9 AND b.plmn = l8.plmn)
SELECT host AS cell, plmn, CAST(sum(n) AS BIGINT) AS n, CAST(sum(ms) AS BIGINT) AS ms, CAST(least(max(most), sum(CAST(pow(7, 10 - res) AS BIGINT))) AS BIGINT) AS units, count(*) AS leaves FROM ho GROUP BY host, plmn""")
def collapse_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("id"), F.col("device_id")
    res = hexgrid.res_for_accuracy((10 + i % 350).cast("double"), F.lit(1.25))
    lat, lng = 1.25 + d % 9 * 0.0006 + i % 5 * 0.0005, 103.6 + d % 7 * 0.0006 + i % 3 * 0.0005
    rows = cut(domain.radio(spark, sf_dir).select("id", "plmn", res.alias("res"), lat.alias("lat"), lng.alias("lng")).where("res is not null"))
    rows = hexgrid.with_cell(rows, "cell", F.col("lat"), F.col("lng"), F.col("res"))
    leaves = rows.groupBy("cell", "plmn").agg(F.count("*").alias("n"), F.sum((1000 + i % 7000).cast("long")).alias("ms"))
    return maps.collapse_overlaps(leaves)


_SHARED = _SAMPLES + f""", sb AS (SELECT *, {LABEL} AS b FROM samples), sn AS (SELECT device_id, cell, count(*) AS n, sum(weight_ms) AS t FROM sb GROUP BY ALL HAVING sum(weight_ms) > 0), sp AS (SELECT device_id, cell, arg_min(plmn, (-w, plmn)) AS network FROM (SELECT device_id, cell, plmn, sum(weight_ms) AS w FROM sb GROUP BY ALL) x GROUP BY ALL),
sq AS (SELECT device_id, cell, b, sum(weight_ms) AS ms FROM sb GROUP BY ALL), sr AS (SELECT sq.device_id, CAST({parent_sql('sq.cell', 9)} AS VARCHAR) AS area, network, b AS band, CAST(floor(n * (CAST(ms AS DOUBLE) / t)) AS BIGINT) AS s, ms FROM sq JOIN sn ON sn.device_id = sq.device_id AND sn.cell = sq.cell JOIN sp ON sp.device_id = sq.device_id AND sp.cell = sq.cell),
sk AS (SELECT device_id, max(wall_ms) AS t FROM samples GROUP BY device_id),
shared AS (SELECT sr.device_id AS contributor, area, network, band, CAST(sum(s) AS BIGINT) AS samples, CAST(sum(ms) AS BIGINT) AS observed_ms, any_value(sk.t) AS t FROM sr JOIN sk ON sk.device_id = sr.device_id GROUP BY sr.device_id, area, network, band HAVING sum(s) >= 5)"""
_WEEK = "CAST(isoyear(make_timestamp({t} * 1000 * 1000 * 700)) AS VARCHAR) || '-W' || lpad(CAST(weekofyear(make_timestamp({t} * 1000 * 1000 * 700)) AS VARCHAR), 2, '0')"


def _contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cut(samples(spark, sf_dir)).withColumn("_real", F.col("wall_ms") * 700000)  # spreads the compressed times over weeks
    return maps.build_contribution(rows, "cell", "device_id", "_real")


@query(_SHARED + f" SELECT contributor, area, network, band, samples, observed_ms, {_WEEK.format(t='t')} AS week FROM shared")
def build_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contribution(spark, sf_dir).select(F.col("device_id").alias("contributor"), "area", "network", "band", "samples", "observed_ms", "week")


@query(_SHARED + " SELECT area, network, band, count(DISTINCT contributor) AS contributors, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(observed_ms) AS BIGINT) AS observed_ms FROM shared GROUP BY ALL HAVING count(DISTINCT contributor) >= 3 AND sum(samples) >= 30")
def crowd_from_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crowd map of what the devices' own bins contribute; weights in time become shares of the samples, as the check of
    records bounds them by the samples."""
    from ..operators import crowd

    c = _contribution(spark, sf_dir)
    share = lambda h: F.transform_values(h, lambda k, w: F.floor(w * F.col("samples") / F.col("observed_ms")).cast("double"))
    rec = c.select(F.col("device_id").alias("contributor"), "area", "network", "band", F.col("samples").cast("double").alias("samples"), F.col("observed_ms").cast("double").alias("observed_ms"), share("rsrp").alias("rsrp"), share("sinr").alias("sinr"), "week")
    return crowd.crowd_aggregate(rec).select("area", "network", "band", "contributors", "samples", "observed_ms")


# ---- sessions, places ----------------------------------------------------------------------------------------------------------

_JOURNEYS = """, jx AS (SELECT *, CASE WHEN wall_ms - lag(wall_ms) OVER (PARTITION BY device_id ORDER BY wall_ms, id) <= 180000 THEN 0 ELSE 1 END AS f FROM fixes WHERE speed_mps > 0.5),
jy AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM jx), js AS (SELECT device_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms FROM jy GROUP BY device_id, k HAVING max(wall_ms) - min(wall_ms) >= 60000)"""
_OUTCOMES = _CHANGES + """, o1 AS (SELECT c.id, bool_or(coalesce(p.outcome = 'FAIL', false)) AS failed FROM ch c LEFT JOIN probes p ON p.device_id = c.device_id AND p.wall_ms BETWEEN c.wall_ms - 4000 AND c.wall_ms + 6000 GROUP BY c.id),
o2 AS (SELECT c.id, count(b.id) > 0 AS returned FROM ch c LEFT JOIN ch b ON b.device_id = c.device_id AND b.sub_id = c.sub_id AND b.ci = c.before AND (b.wall_ms > c.wall_ms OR b.wall_ms = c.wall_ms AND b.id > c.id) AND b.wall_ms - c.wall_ms <= 30000 GROUP BY c.id),
oc AS (SELECT ch.device_id, ch.wall_ms, CASE WHEN returned THEN 'ping-pong' WHEN failed THEN 'failed' ELSE 'clean' END AS outcome FROM ch JOIN o1 USING (id) JOIN o2 USING (id))"""
_SUMMARY = _WEIGHTED + _JOURNEYS + _OUTCOMES + _COLD + _TYPED + """, q1 AS (SELECT js.device_id, start_ms, count(*) AS readings, count(DISTINCT ci) AS distinct_cells, sum(weight_ms) AS w, list_sort(list(sinr)) AS s FROM js JOIN weighted r ON r.device_id = js.device_id AND r.wall_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
q2 AS (SELECT js.device_id, start_ms, count(*) AS cell_changes, count(*) FILTER (outcome = 'clean') AS clean, count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'ping-pong') AS returns FROM js JOIN oc ON oc.device_id = js.device_id AND oc.wall_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
q3 AS (SELECT js.device_id, start_ms, count(*) AS probes, count(*) FILTER (outcome <> 'OK' AND kind NOT IN ('INSTRUMENT', 'RECOVERY', 'NO_BEARER')) AS probe_fail FROM js JOIN pt1 ON pt1.device_id = js.device_id AND pt1.wall_ms BETWEEN start_ms AND end_ms GROUP BY ALL),
qs AS (SELECT js.*, coalesce(readings, 0) AS readings, coalesce(distinct_cells, 0) AS distinct_cells, s[CAST(least(len(s) - 1, floor(len(s) * 0.1::DOUBLE)) AS BIGINT) + 1] AS sinr_p10, s[CAST(least(len(s) - 1, floor(len(s) * 0.5::DOUBLE)) AS BIGINT) + 1] AS sinr_p50, s[CAST(least(len(s) - 1, floor(len(s) * 0.9::DOUBLE)) AS BIGINT) + 1] AS sinr_p90,
  coalesce(cell_changes, 0) AS cell_changes, coalesce(clean, 0) AS clean, coalesce(failed, 0) AS failed, coalesce(returns, 0) AS returns, coalesce(probes, 0) AS probes, coalesce(probe_fail, 0) AS probe_fail, least(1, coalesce(CAST(w AS DOUBLE) / nullif(end_ms - start_ms, 0), 0)) AS coverage FROM js LEFT JOIN q1 USING (device_id, start_ms) LEFT JOIN q2 USING (device_id, start_ms) LEFT JOIN q3 USING (device_id, start_ms))"""


def _summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sessions = devices.journeys(domain.fixes(spark, sf_dir), ["device_id"], "wall_ms", "speed_mps")
    fails = domain.probes(spark, sf_dir).where("outcome = 'FAIL'").select("device_id", "wall_ms")
    outcomes = studies.handover_outcomes(_cell_changes(spark, sf_dir), fails, ["device_id"], "sub_id").select("device_id", "wall_ms", "outcome")
    return maps.session_summary(sessions, _weighted(spark, sf_dir).select("device_id", "wall_ms", "ci", "sinr", "weight_ms"), typed_probes(spark, sf_dir).select("device_id", "wall_ms", "outcome", "kind"), outcomes, ["device_id"])


@query(_SUMMARY + " SELECT * REPLACE (round(coverage, 6) AS coverage) FROM qs")
def session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_summaries(spark, sf_dir), "coverage")


@query(_SUMMARY + " SELECT device_id, start_ms, CASE WHEN coverage < 0.3::DOUBLE THEN 'unreadable' WHEN failed + clean < 5 THEN 'too few' WHEN failed >= 0.25 * (failed + clean) THEN 'bad' WHEN failed >= 0.1 * (failed + clean) THEN 'watch' ELSE 'clean' END AS verdict FROM qs")
def journey_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maps.journey_verdict(_summaries(spark, sf_dir)).select("device_id", "start_ms", "verdict")


@query(""", fm AS (SELECT device_id, wall_ms, max_by(speed_mps, id) AS speed FROM fixes GROUP BY ALL),
y0 AS (SELECT r.*, ci // 2560 AS tac, id % 4 <> 0 AS fresh, CASE WHEN r.wall_ms - f.wall_ms <= 120000 THEN f.speed END AS speed FROM radio r ASOF LEFT JOIN fm f ON f.device_id = r.device_id AND f.wall_ms <= r.wall_ms),
y1 AS (SELECT *, coalesce(lag(ci) OVER w <> ci, false)::INT AS moved, CASE WHEN lag(tac) OVER w <> tac THEN wall_ms END AS tc FROM y0 WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
y2 AS (SELECT *, last_value(tc IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS lt, least(180000, wall_ms - min(wall_ms) OVER (PARTITION BY device_id)) AS span, count(*) OVER b AS n, sum(fresh::INT) OVER b AS fr, list_unique(list(ci) OVER b) AS cells, sum(moved) OVER b - arg_min(moved, (wall_ms, id)) OVER b AS changes
  FROM y1 WINDOW b AS (PARTITION BY device_id ORDER BY wall_ms RANGE BETWEEN 180000 PRECEDING AND CURRENT ROW)),
y3 AS (SELECT *, span < 60000 OR fr < 0.3::DOUBLE * n AS blind, coalesce(wall_ms - lt <= 300000, false) AS tk FROM y2)
SELECT id, CASE WHEN speed IS NOT NULL THEN CASE WHEN speed < 0.5 THEN 'STATIONARY' WHEN speed < 2.5 THEN 'WALKING' WHEN speed < 22 THEN 'VEHICLE' ELSE 'FAST' END WHEN tk THEN 'VEHICLE' WHEN blind THEN 'UNKNOWN' WHEN cells / (span / 60000) >= 3 THEN 'FAST' WHEN cells / (span / 60000) >= 1 THEN 'VEHICLE' WHEN changes / (span / 60000) >= 1 THEN 'WALKING' ELSE 'STATIONARY' END AS class,
  CASE WHEN speed IS NOT NULL THEN 'MEASURED' WHEN tk THEN 'INDICATIVE' WHEN blind THEN 'NONE' ELSE 'WEAK' END AS confidence FROM y3""")
def mobility_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = domain.fixes(spark, sf_dir).groupBy("device_id", "wall_ms").agg(F.max_by("speed_mps", "id").alias("speed"))
    rows = domain.radio(spark, sf_dir).select("device_id", "id", "wall_ms", "ci", F.floor(F.col("ci") / 2560).alias("tac"), (F.col("id") % 4 != 0).alias("fresh"))
    return maps.mobility_class(rows, fixes, ["device_id"], "wall_ms", ["wall_ms", "id"]).select("id", "class", "confidence")


_AHEAD = _AREA + f""", pq AS (SELECT cell, hour, ((cell - {hexgrid.TAG + (8 << 56)}) // 268435456 + 134217728) % 268435456 - 134217728 AS q, ((cell - {hexgrid.TAG + (8 << 56)}) % 268435456 + 134217728) % 268435456 - 134217728 AS r FROM bh), ar AS (SELECT cell, hour, unnest({_around()}) AS c FROM pq),
ah AS (SELECT ar.cell, ar.hour, coalesce(bool_or(bh.below * 4 >= bh.samples) FILTER (ar.c <> ar.cell AND bh.samples >= 5), false) AND NOT coalesce(bool_or(bh.below * 4 >= bh.samples) FILTER (ar.c = ar.cell AND bh.samples >= 5), false) AS ahead FROM ar LEFT JOIN bh ON bh.cell = ar.c AND bh.hour = ar.hour GROUP BY ar.cell, ar.hour),
al AS (SELECT r.device_id, r.id, r.wall_ms FROM radio r ASOF JOIN fc f ON f.device_id = r.device_id AND f.wall_ms <= r.wall_ms JOIN ah ON ah.cell = f.cell AND ah.hour = r.wall_ms // 3600 % 24 WHERE r.wall_ms - f.wall_ms <= 60000 AND ahead AND id % 7 <> 0)"""


from .devices import _THROTTLED  # noqa: E402


@query(_AHEAD + _THROTTLED.format(rows="al", gap=600000) + " SELECT tk.id, tk.wall_ms FROM th JOIN tk ON tk.device_id = th.device_id AND tk.k = th.k")
def lookahead_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts where the next area has been poor at this hour and this one is not, unless the area is poor already; then quiet."""
    hours = _bin_hours(spark, sf_dir)
    verdict = studies.lookahead(hours.select("cell", "hour"), hours, "cell", hexgrid.neighbours(F.col("cell")), least=5, bad=0.25).where("bad_ahead").select("cell", "hour")
    f = hexgrid.with_cell(domain.fixes(spark, sf_dir), "_c", F.col("lat"), F.col("lng"), 9).withColumn("cell", hexgrid.parent(F.col("_c"), 8)).groupBy("device_id", "wall_ms").agg(F.max_by("cell", "id").alias("cell"))
    rows = timeline.asof_join(domain.radio(spark, sf_dir).where("id % 7 <> 0"), f, ["device_id"], "wall_ms", ["cell"], max_age=60000).withColumn("hour", F.floor(F.col("wall_ms") / 3600) % 24)
    return devices.throttled(rows.join(verdict, ["cell", "hour"]).select("device_id", "id", "wall_ms"), ["device_id"], "wall_ms", ["wall_ms", "id"], 600000).select("id", "wall_ms")


@query(_SITES + """, sp AS (SELECT plmn, enb, band, (hour + d + 24) % 24 AS hour, samples, below FROM sh, (VALUES (-2), (-1), (0), (1), (2)) v(d)), g AS (SELECT plmn, enb, band, hour, CAST(sum(samples) AS BIGINT) AS samples, sum(below) AS below FROM sp GROUP BY ALL),
hl AS (SELECT device_id, arg_max(plmn, (wall_ms, id)) AS plmn, arg_max(ci // 256, (wall_ms, id)) AS enb, arg_max(band, (wall_ms, id)) AS band, arg_max(wall_ms // 3600 % 24, (wall_ms, id)) AS hour, max(wall_ms) AS t FROM radio WHERE rat = 'LTE' GROUP BY device_id),
hn AS (SELECT hl.device_id, count(*) AS n, CAST(count(*) FILTER (sinr < 0) AS DOUBLE) / count(*) AS share FROM hl JOIN radio r ON r.device_id = hl.device_id AND r.wall_ms BETWEEN hl.t - 600000 AND hl.t GROUP BY hl.device_id)
SELECT hl.device_id, CASE WHEN n < 30 THEN 'UNKNOWN' WHEN share >= 0.7::DOUBLE THEN 'BAD' WHEN share > 0.3::DOUBLE THEN 'MARGINAL' ELSE 'GOOD' END AS grade, CASE WHEN g.samples >= 80 AND CAST(g.below AS DOUBLE) / g.samples >= 0.25 THEN 'poor' WHEN g.samples >= 80 THEN 'fine' ELSE 'no record' END AS before
FROM hl JOIN hn USING (device_id) LEFT JOIN g ON g.plmn = hl.plmn AND g.enb = hl.enb AND g.band = hl.band AND g.hour = hl.hour""")
def here_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.radio(spark, sf_dir)
    last = rows.where("rat = 'LTE'").withColumn("enb", radio.enb(F.col("rat"), F.col("ci"))).withColumn("hour", F.floor(F.col("wall_ms") / 3600) % 24).groupBy("device_id").agg(F.max_by(F.struct("plmn", "enb", "band", "hour"), F.struct("wall_ms", "id")).alias("x"), F.max("wall_ms").alias("_t"))
    recent = rows.join(last.select("device_id", "_t"), "device_id").where("wall_ms between _t - 600000 and _t").groupBy("device_id").agg(F.count("*").alias("n"), (F.count_if(F.col("sinr") < 0) / F.count("*")).alias("share"))
    latest = last.select("device_id", "x.*").join(recent, "device_id")
    return maps.here_card(latest, studies.circular_verdict(_site_hours(spark, sf_dir), ["plmn", "enb", "band"])).select("device_id", "grade", "before")


@query(_SITES + """, pt AS (SELECT plmn, enb, band, CASE WHEN hour <= 6 THEN 'overnight' WHEN hour <= 11 THEN 'morning' WHEN hour <= 17 THEN 'afternoon' ELSE 'evening' END AS part, sum(samples) AS n, sum(below) AS b FROM sh GROUP BY ALL HAVING sum(samples) >= 10)
SELECT plmn, enb, band, arg_min(part, (CAST(b AS DOUBLE) / n, part)) AS part, round(min(CAST(b AS DOUBLE) / n), 6) AS share FROM pt GROUP BY plmn, enb, band HAVING min(CAST(b AS DOUBLE) / n) < 0.5""")
def site_best_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(studies.best_part(_site_hours(spark, sf_dir), ["plmn", "enb", "band"], least=10, bad=1.0), "share")


@query(", bx AS (SELECT n_nationkey AS box, -170.0::DOUBLE + n_nationkey * 13 AS west, -60.0::DOUBLE + n_nationkey * 4 AS south, CASE WHEN n_nationkey % 5 = 0 THEN -175.0::DOUBLE ELSE -160.0::DOUBLE + n_nationkey * 13 + n_nationkey % 4 * 9 END AS east, -50.0::DOUBLE + n_nationkey * 4 + n_nationkey % 6 AS north FROM nation), " + ", ".join(f"t{z} AS (SELECT box, CASE WHEN west <= east THEN x1 - x0 + 1 ELSE {1 << z} - x0 + x1 + 1 END * (y1 - y0 + 1) AS n FROM (SELECT box, west, east, greatest(0, least({(1 << z) - 1}, CAST(floor((west + 180) / 360 * {1 << z}) AS BIGINT))) AS x0, greatest(0, least({(1 << z) - 1}, CAST(floor((east + 180) / 360 * {1 << z}) AS BIGINT))) AS x1, CAST(floor((1 - ln(tan(radians(north)) + 1 / cos(radians(north))) / pi()) / 2 * {1 << z}) AS BIGINT) AS y0, CAST(floor((1 - ln(tan(radians(south)) + 1 / cos(radians(south))) / pi()) / 2 * {1 << z}) AS BIGINT) AS y1 FROM bx) q)" for z in range(5, 10)) + " SELECT bx.box, CAST(CASE WHEN t9.n <= 3500 THEN 9 WHEN t8.n <= 3500 THEN 8 WHEN t7.n <= 3500 THEN 7 WHEN t6.n <= 3500 THEN 6 ELSE 5 END AS INT) AS zoom, CASE WHEN t9.n <= 3500 THEN t9.n WHEN t8.n <= 3500 THEN t8.n WHEN t7.n <= 3500 THEN t7.n WHEN t6.n <= 3500 THEN t6.n ELSE t5.n END AS tiles FROM bx JOIN t5 USING (box) JOIN t6 USING (box) JOIN t7 USING (box) JOIN t8 USING (box) JOIN t9 USING (box)")
def tile_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(k.alias("box"), (-170.0 + k * 13).alias("west"), (-60.0 + k * 4).alias("south"), F.when(k % 5 == 0, -175.0).otherwise(-160.0 + k * 13 + k % 4 * 9).alias("east"), (-50.0 + k * 4 + k % 6).alias("north"))
    return maps.tile_cover(boxes).select("box", "zoom", "tiles")
