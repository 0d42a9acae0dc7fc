"""Queries of bands, transfer asymmetry, handover outcomes and the ping-pong study."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import domain
from ..functions import bands, radio
from ..operators import studies, timeline
from ..operators.lineage import cut
from .core import _CHANGES, _FIXED, _cell_changes, _round, located
from .coverage import _MATCHED, _pingpong
from .registry import query

_CH = ", c AS (SELECT id, rat, CASE WHEN rat = 'LTE' THEN id * 37 % 72000 ELSE 120000 + id * 7919 % 3200000 END AS channel, CASE id % 3 WHEN 0 THEN '310' WHEN 1 THEN '525' END AS mcc FROM radio)"


@query(_CH + f""", lt(band, low, first, last) AS (VALUES {bands.lte_values()}), nb(place, band, lo, hi, only2, preferred, renumbered) AS (VALUES {bands.nr_values()}),
m AS (SELECT *, CASE WHEN channel <= 599999 THEN 0.005::DOUBLE * channel WHEN channel <= 2016666 THEN 3000 + 0.015::DOUBLE * (channel - 600000) WHEN channel <= 3279165 THEN 24250.08::DOUBLE + 0.06::DOUBLE * (channel - 2016667) END AS f FROM c WHERE rat = 'NR'),
nn AS (SELECT m.id, nb.band, nb.renumbered, CASE WHEN mcc = '525' THEN only2 = 0 ELSE true END AS usable, CASE WHEN mcc = '310' THEN 1 - preferred ELSE 0 END AS pref, place FROM m JOIN nb ON f >= lo::DOUBLE AND f <= hi::DOUBLE),
nx AS (SELECT id, arg_min(band, (NOT usable, pref, place)) AS band, CASE WHEN count(*) FILTER (usable) > 0 THEN count(*) FILTER (usable AND renumbered = 0) ELSE count(*) FILTER (renumbered = 0) END > 1 AS ambiguous FROM nn GROUP BY id)
SELECT c.id, coalesce(lt.band, nx.band) AS band, CASE WHEN lt.band IS NOT NULL THEN false ELSE nx.ambiguous END AS ambiguous FROM c LEFT JOIN lt ON c.rat = 'LTE' AND c.channel BETWEEN lt.first AND lt.last LEFT JOIN nx ON nx.id = c.id""")
def derive_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = domain.radio(spark, sf_dir).select("id", "rat", F.when(F.col("rat") == "LTE", i * 37 % 72000).otherwise(120000 + i * 7919 % 3200000).alias("channel"), F.when(i % 3 == 0, "310").when(i % 3 == 1, "525").alias("mcc"))
    return bands.derive_bands(rows, "rat", "channel", "mcc").select("id", "band", "ambiguous")


_PAIRS = """, x AS (SELECT *, CASE WHEN lag(id % 2) OVER w <> id % 2 AND wall_ms - lag(wall_ms) OVER w <= 60000 THEN 0 ELSE 1 END AS f FROM probes WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x),
z AS (SELECT *, row_number() OVER w AS rn, lead(latency_ms) OVER w AS l2, lead(outcome) OVER w AS o2 FROM y WINDOW w AS (PARTITION BY device_id, k ORDER BY wall_ms, id)),
p0 AS (SELECT id % 2 = 1 AS led, latency_ms AS l1, outcome AS o1, l2, o2 FROM z WHERE rn % 2 = 1 AND l2 IS NOT NULL),
p AS (SELECT led, CASE WHEN led THEN l1 ELSE l2 END AS down, CASE WHEN led THEN l2 ELSE l1 END AS up, CASE WHEN led THEN o1 ELSE o2 END <> 'OK' AS df, CASE WHEN led THEN o2 ELSE o1 END <> 'OK' AS uf, o1 = 'OK' AND o2 = 'OK' AND l1 > 0 AND l2 > 0 AS complete FROM p0),
g AS (SELECT count(*) AS pairs, count(*) FILTER (complete) AS complete, count(*) FILTER (uf) AS up_failed, count(*) FILTER (df) AS down_failed, count(*) FILTER (led) AS down_first, list_sort(list(down) FILTER (complete)) AS ds, list_sort(list(up) FILTER (complete)) AS us,
  avg(CASE WHEN complete THEN ln(CAST(up AS DOUBLE) / down) END) AS m, stddev_samp(CASE WHEN complete THEN ln(CAST(up AS DOUBLE) / down) END) AS s FROM p),
ci AS (SELECT *, exp(m) AS ratio, exp(m - 1.96::DOUBLE * s / sqrt(complete)) AS lo, exp(m + 1.96::DOUBLE * s / sqrt(complete)) AS hi FROM g)"""


@query(_PAIRS + """ SELECT pairs, complete, up_failed, down_failed, down_first, ds[complete // 2 + 1] AS down_ms, us[complete // 2 + 1] AS up_ms, round(ratio, 6) AS ratio, round(lo, 6) AS lo, round(hi, 6) AS hi,
  CASE WHEN complete < 10 THEN 'too few' WHEN up_failed + down_failed > pairs // 4 THEN 'incomplete' WHEN down_first < 0.3 * pairs OR down_first > 0.7 * pairs THEN 'confounded' WHEN lo IS NULL THEN 'no interval' WHEN hi / lo > 10 THEN 'too variable'
    WHEN lo > 1 THEN 'uplink slower' WHEN hi < 1 THEN 'downlink slower' ELSE 'no asymmetry' END AS gate FROM ci""")
def transfer_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.probes(spark, sf_dir).withColumn("direction", F.when(F.col("id") % 2 == 1, "DOWN").otherwise("UP"))
    pairs = studies.pair_transfers(rows, ["device_id"], "wall_ms", "direction", ["wall_ms", "id"])
    return _round(studies.asymmetry(pairs, rows), "ratio", "lo", "hi")


@query(_CHANGES + """, o AS (SELECT c.id, bool_or(coalesce(p.outcome = 'FAIL', false)) AS failed FROM ch c LEFT JOIN probes p ON p.device_id = c.device_id AND p.wall_ms BETWEEN c.wall_ms - 4000 AND c.wall_ms + 6000 GROUP BY c.id),
r AS (SELECT c.id, count(b.id) > 0 AS returned FROM ch c LEFT JOIN ch b ON b.device_id = c.device_id AND b.sub_id = c.sub_id AND b.ci = c.before AND (b.wall_ms > c.wall_ms OR b.wall_ms = c.wall_ms AND b.id > c.id) AND b.wall_ms - c.wall_ms <= 30000 GROUP BY c.id)
SELECT o.id, CASE WHEN returned THEN 'ping-pong' WHEN failed THEN 'failed' ELSE 'clean' END AS outcome FROM o JOIN r USING (id)""")
def handover_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = domain.probes(spark, sf_dir).where("outcome = 'FAIL'").select("device_id", "wall_ms")
    return studies.handover_outcomes(_cell_changes(spark, sf_dir), fails, ["device_id"], "sub_id").select("id", "outcome")


@query(_MATCHED + """, arms AS (SELECT 'case' AS arm, case_id AS id FROM pairs UNION ALL SELECT 'control', control_id FROM pairs),
ft AS (SELECT DISTINCT pc.id FROM pc JOIN probes f ON f.device_id = pc.device_id AND f.outcome = 'FAIL' AND f.wall_ms BETWEEN pc.t - 36000 AND pc.t + 6000),
ag AS (SELECT arm, count(*) AS n, count(ft.id) AS failed, CAST(count(ft.id) AS DOUBLE) / count(*) AS share FROM arms LEFT JOIN ft ON ft.id = arms.id GROUP BY arm),
wi AS (SELECT *, (share + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) AS mid, 1.96::DOUBLE * sqrt(share * (1 - share) / n + 3.8416::DOUBLE / (4.0 * n * n)) / (1 + 3.8416::DOUBLE / n) AS half FROM ag)
SELECT arm, n, failed, round(share, 6) AS share, round(greatest(0, mid - half), 6) AS lo, round(least(1, mid + half), 6) AS hi, n >= 20 AS valid FROM wi""")
def pingpong_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _pingpong(spark, sf_dir).where("not is_return")
    pairs = studies.match_controls(rows, ["device_id", "sub_id"], "id", "churn", "pingpong", ["wall_ms", "id"])
    fails = domain.probes(spark, sf_dir).where("outcome = 'FAIL'").select("device_id", "wall_ms")
    return _round(studies.case_control(pairs, rows, fails, ["device_id"]), "share", "lo", "hi")


def _wilson_sql(failed: str, sign: str) -> str:
    share = f"(CAST({failed} AS DOUBLE) / n)"
    return f"{'least(1, ' if sign == '+' else 'greatest(0, '}(({share} + 3.8416::DOUBLE / (2 * n)) {sign} 1.96::DOUBLE * sqrt({share} * (1 - {share}) / n + 3.8416::DOUBLE / (4.0 * n * n))) / (1 + 3.8416::DOUBLE / n))"


@query(_MATCHED + f""", kd AS (SELECT id, ci, lag(rat) OVER w AS rat0, rat, lag(ci) OVER w AS ci0 FROM radio WINDOW w AS (PARTITION BY device_id, sub_id ORDER BY wall_ms, id)),
kn AS (SELECT id, CASE WHEN rat <> 'LTE' OR rat0 <> 'LTE' THEN 'undecomposable' WHEN ci // 256 = ci0 // 256 THEN 'sector' ELSE 'mast' END AS kind FROM kd),
ft AS (SELECT DISTINCT pc.id FROM pc JOIN probes f ON f.device_id = pc.device_id AND f.outcome = 'FAIL' AND f.wall_ms BETWEEN pc.t - 36000 AND pc.t + 6000),
pr AS (SELECT kind, a.churn AS case_churn, b.churn AS control_churn, case_id IN (SELECT id FROM ft) AS case_f, control_id IN (SELECT id FROM ft) AS control_f FROM pairs JOIN kn ON kn.id = case_id JOIN pc a ON a.id = case_id JOIN pc b ON b.id = control_id),
lb AS (SELECT 'overall' AS label, * FROM pr UNION ALL SELECT kind, * FROM pr WHERE kind IN ('sector', 'mast')),
gr AS (SELECT label, count(*) AS n, count(*) FILTER (case_f) AS a, count(*) FILTER (control_f) AS b, list_sort(list(case_churn)) AS ca, list_sort(list(control_churn)) AS cb FROM lb GROUP BY label)
SELECT label, n AS pairs, a AS case_failed, b AS control_failed, ca[n // 2 + 1] AS case_churn, cb[n // 2 + 1] AS control_churn,
  CASE WHEN n < 20 OR a + b = 0 THEN 'invalid' WHEN {_wilson_sql('a', '-')} > {_wilson_sql('b', '+')} THEN 'harmful' WHEN {_wilson_sql('a', '+')} < {_wilson_sql('b', '-')} THEN 'protective' ELSE 'no association' END AS verdict FROM gr""")
def pingpong_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's verdicts over all pairs, and over returns between sectors of a mast and between masts."""
    by = Window.partitionBy("device_id", "sub_id").orderBy("wall_ms", "id")
    known = domain.radio(spark, sf_dir).withColumns({"_rat": F.lag("rat").over(by), "_ci": F.lag("ci").over(by)})
    mast = lambda c: F.floor(F.col(c) / 256)
    kinds = known.select("id", F.when((F.col("rat") != "LTE") | (F.col("_rat") != "LTE"), "undecomposable").when(mast("ci") == mast("_ci"), "sector").otherwise("mast").alias("kind"))
    rows = cut(_pingpong(spark, sf_dir).where("not is_return").join(kinds, "id"))  # the pairs and both arms read them
    pairs = studies.match_controls(rows, ["device_id", "sub_id"], "id", "churn", "pingpong", ["wall_ms", "id"])
    fails = domain.probes(spark, sf_dir).where("outcome = 'FAIL'").select("device_id", "wall_ms")
    return studies.verdicts(pairs, rows, fails, ["device_id"])


def _changes_with_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = Window.partitionBy("device_id", "sub_id").orderBy("wall_ms", "id")
    known = domain.radio(spark, sf_dir).withColumns({"_rat": F.lag("rat").over(by), "_ci": F.lag("ci").over(by)})
    mast = lambda c: F.floor(F.col(c) / 256)
    kinds = known.select("id", F.when((F.col("rat") != "LTE") | (F.col("_rat") != "LTE"), "undecomposable").when(mast("ci") == mast("_ci"), "sector").otherwise("mast").alias("kind"))
    return cut(_pingpong(spark, sf_dir).join(kinds, "id"))  # the pairs, the windows and both arms read them


@query(_MATCHED + f""", kd AS (SELECT id, ci, lag(rat) OVER w AS rat0, rat, lag(ci) OVER w AS ci0 FROM radio WINDOW w AS (PARTITION BY device_id, sub_id ORDER BY wall_ms, id)),
kn AS (SELECT id, CASE WHEN rat <> 'LTE' OR rat0 <> 'LTE' THEN 'undecomposable' WHEN ci // 256 = ci0 // 256 THEN 'sector' ELSE 'mast' END AS kind FROM kd),
oc AS (SELECT device_id, NULL::INT AS sub_id, wall_ms, CASE WHEN outcome = 'FAIL' THEN 'probe' ELSE 'ok' END AS what, latency_ms FROM probes WHERE net_id <> '' UNION ALL SELECT device_id, NULL, wall_ms, 'route', NULL FROM links WHERE transport = 'CELLULAR' AND NOT validated UNION ALL SELECT device_id, sub_id, wall_ms, 'service', NULL FROM regs WHERE reg_state = 'OUT_OF_SERVICE'),
mt AS (SELECT pc.id, what, oc.latency_ms FROM pc JOIN oc ON oc.device_id = pc.device_id AND oc.wall_ms BETWEEN pc.t - 36000 AND pc.t + 6000 WHERE what <> 'service' OR oc.sub_id = pc.sub_id),
fl AS (SELECT id, max((what = 'probe')::INT) AS probe, max((what = 'route')::INT) AS route, max((what = 'service')::INT) AS service FROM mt WHERE what <> 'ok' GROUP BY id),
ar AS (SELECT label, x.arm, x.id FROM (SELECT unnest(['overall', kind]) AS label, case_id, control_id FROM pairs JOIN kn ON kn.id = case_id) p, LATERAL (SELECT 'case' AS arm, p.case_id AS id UNION ALL SELECT 'control', p.control_id) x WHERE label IN ('overall', 'sector', 'mast')),
rw AS (SELECT ar.*, churn, coalesce(probe, 0) AS probe, coalesce(route, 0) AS route, coalesce(service, 0) AS service, greatest(coalesce(probe, 0), coalesce(route, 0), coalesce(service, 0)) AS harm FROM ar JOIN pc ON pc.id = ar.id LEFT JOIN fl ON fl.id = ar.id),
tl AS (SELECT label, arm, count(*) AS n, CAST(sum(probe) AS BIGINT) AS probe, CAST(sum(route) AS BIGINT) AS route, CAST(sum(service) AS BIGINT) AS service, CAST(sum(harm) AS BIGINT) AS harm, list_sort(list(churn))[count(*) // 2 + 1] AS churn FROM rw GROUP BY ALL),
wt AS (SELECT label, arm, list_sort(list(latency_ms)) AS l FROM ar JOIN mt ON mt.id = ar.id WHERE what = 'ok' GROUP BY ALL), lt AS (SELECT label, arm, l[CAST(floor((len(l) - 1) * 0.5::DOUBLE + 0.5) AS BIGINT) + 1] AS p50, l[CAST(floor((len(l) - 1) * 0.9::DOUBLE + 0.5) AS BIGINT) + 1] AS p90 FROM wt),
cw AS (SELECT device_id, sub_id, wall_ms, greatest(0, least(30000, coalesce(lead(wall_ms) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id) - wall_ms, 0))) AS w FROM radio), sg AS (SELECT sum(w) AS w, max(wall_ms) - min(wall_ms) AS s FROM cw GROUP BY device_id, sub_id), cv AS (SELECT sum(w) AS fresh, sum(s) AS span FROM sg),
tw AS (SELECT t.*, p50, p90 FROM tl t LEFT JOIN lt ON lt.label = t.label AND lt.arm = t.arm), a AS (SELECT * FROM tw WHERE arm = 'case'), b AS (SELECT * FROM tw WHERE arm = 'control'),
jd AS (SELECT l.label, coalesce(a.n, 0) AS n, a.probe AS case_probe, a.route AS case_route, a.service AS case_service, a.harm AS ca, a.p50 AS case_p50_ms, a.p90 AS case_p90_ms, a.churn AS case_churn, b.probe AS control_probe, b.route AS control_route, b.service AS control_service, b.harm AS cb, b.p50 AS control_p50_ms, b.p90 AS control_p90_ms, b.churn AS control_churn,
  CASE WHEN fresh = 0 THEN 'no fresh readings' WHEN coalesce(fresh / nullif(span, 0), 0) < 0.3::DOUBLE THEN 'coverage' WHEN (SELECT count(*) FROM pp WHERE is_return) < 20 THEN 'few returns' WHEN (SELECT count(*) FROM pairs) = 0 THEN 'no matches' WHEN coalesce(a.n, 0) < 20 THEN 'few pairs' WHEN a.harm + b.harm = 0 THEN 'no harm' END AS invalid
  FROM (VALUES ('overall'), ('sector'), ('mast')) l(label) LEFT JOIN a ON a.label = l.label LEFT JOIN b ON b.label = l.label, cv)
SELECT label, n AS pairs, case_probe, case_route, case_service, ca AS case_any, case_p50_ms, case_p90_ms, case_churn, control_probe, control_route, control_service, cb AS control_any, control_p50_ms, control_p90_ms, control_churn, invalid,
  CASE WHEN invalid IS NOT NULL THEN 'invalid' WHEN {_wilson_sql('ca', '-')} > {_wilson_sql('cb', '+')} THEN 'harmful' WHEN {_wilson_sql('ca', '+')} < {_wilson_sql('cb', '-')} THEN 'protective' ELSE 'no association' END AS verdict FROM jd""")
def pingpong_study(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ping-pong study over failed probes, lost routes and drops of service, with the coverage of the readings as a gate."""
    changes = _changes_with_kind(spark, sf_dir)
    pairs = studies.match_controls(changes.where("not is_return"), ["device_id", "sub_id"], "id", "churn", "pingpong", ["wall_ms", "id"])
    none = lambda kind: F.lit(None).cast(kind)
    probes = domain.probes(spark, sf_dir).where("net_id <> ''").select("device_id", none("int").alias("sub_id"), "wall_ms", F.when(F.col("outcome") == "FAIL", "probe").otherwise("ok").alias("what"), "latency_ms")
    routes = domain.links(spark, sf_dir).where("transport = 'CELLULAR' and not validated").select("device_id", none("int"), "wall_ms", F.lit("route"), none("int"))
    drops = domain.registrations(spark, sf_dir).where("reg_state = 'OUT_OF_SERVICE'").select("device_id", "sub_id", "wall_ms", F.lit("service"), none("int"))
    weighted = timeline.time_weight(domain.radio(spark, sf_dir), ["device_id", "sub_id"], "wall_ms", ["id"])
    coverage = timeline.coverage(weighted, ["device_id", "sub_id"]).agg(F.sum("observed_ms").alias("fresh_ms"), F.sum("span_ms").alias("span_ms"))
    return studies.outcome_study(pairs, changes, probes.union(routes).union(drops), coverage)


@query("""SELECT count(DISTINCT (plmn, ci // 256)) AS masts, count(DISTINCT (plmn, ci // 256, band, wall_ms // 3600000 % 24)) AS slots, count(*) AS samples, (SELECT count(*) FROM radio WHERE wall_ms > 2000000) AS behind
  FROM radio WHERE wall_ms <= 2000000 AND rat = 'LTE'""")
def site_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, mark = domain.radio(spark, sf_dir), 2000000
    known = r.where(F.col("wall_ms") <= mark).withColumn("site", radio.enb(F.col("rat"), F.col("ci"))).where("site is not null")
    hours = studies.site_hours(known, ["plmn", "site", "band"], F.floor(F.col("wall_ms") / 3600000) % 24)
    return studies.site_status(hours, ["plmn", "site"], r, mark)


@query(_FIXED + " SELECT device_id, count(*) AS samples, count(cell) AS located FROM located GROUP BY device_id")
def located_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return located(spark, sf_dir).groupBy("device_id").agg(F.count("*").alias("samples"), F.count("cell").alias("located"))
