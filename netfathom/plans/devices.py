"""Queries of the device, source and sink operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..functions import hexgrid
from ..operators import devices, faults, intervals, timeline
from ..sources import bundles, tables
from .core import _COLD, _round, feature_sql, hex_sql
from .registry import SQL, query


@query(""", x AS (SELECT *, CASE WHEN wall_ms - lag(wall_ms) OVER (PARTITION BY device_id ORDER BY wall_ms, id) <= 180000 THEN 0 ELSE 1 END AS f FROM fixes WHERE speed_mps > 0.5),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT device_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms, count(*) AS n FROM y GROUP BY device_id, k HAVING max(wall_ms) - min(wall_ms) >= 60000""")
def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.journeys(domain.fixes(spark, sf_dir), ["device_id"], "wall_ms", "speed_mps")


@query(""", x AS (SELECT *, transport = 'CELLULAR' AS bad, lead(wall_ms) OVER w AS nx, lag(transport = 'CELLULAR') OVER w AS was FROM links WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
y AS (SELECT *, sum(CASE WHEN bad IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x),
iv AS (SELECT device_id, min(wall_ms) AS start_ms, coalesce(arg_max(coalesce(nx, -1), (wall_ms, id)), -1) AS nx, max(wall_ms) AS lst FROM y WHERE bad GROUP BY device_id, k)
SELECT device_id, start_ms, CASE WHEN nx < 0 THEN lst ELSE nx END AS end_ms, nx < 0 AS ongoing FROM iv WHERE CASE WHEN nx < 0 THEN lst ELSE nx END - start_ms > 30000""")
def excursions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.state_intervals(domain.links(spark, sf_dir), ["device_id"], "wall_ms", F.col("transport") == "CELLULAR", ["wall_ms", "id"]).where("end_ms - start_ms > 30000")


_WI = "({p} + {d} * 1.96 * 1.96 / (2 * {n}) {s} {d} * 1.96 * sqrt({p} * (1 - {p}) / {n} + 1.96 * 1.96 / (4 * {n} * {n}))) / (1 + {d} * 1.96 * 1.96 / {n})".replace("{d}", "1.0::DOUBLE")


@query(_COLD + """, hc AS (SELECT device_id, count(*) FILTER (cold) AS n_cold, count(*) FILTER (NOT cold) AS n_warm, count(*) FILTER (cold AND outcome = 'FAIL') AS cold_fail, count(*) FILTER (NOT cold AND outcome = 'FAIL') AS warm_fail,
  list_sort(list(latency_ms) FILTER (cold AND outcome = 'OK')) AS oks FROM cold WHERE net_id <> '' GROUP BY device_id),
hr AS (SELECT *, len(oks) AS ok_n, oks[CAST(floor(0.9::DOUBLE * (len(oks) - 1) + 0.5) AS BIGINT) + 1] AS p90_ms, CAST(n_cold - cold_fail AS DOUBLE) / nullif(n_cold, 0) AS c, CAST(n_warm - warm_fail AS DOUBLE) / nullif(n_warm, 0) AS w FROM hc),
hi AS (SELECT *, CASE WHEN n_cold > 0 THEN least(1, """ + _WI.format(p="c", n="n_cold", s="+") + """) ELSE 1 END AS chi, CASE WHEN n_warm > 0 THEN greatest(0, """ + _WI.format(p="w", n="n_warm", s="-") + """) ELSE 0 END AS wlo FROM hr)
SELECT device_id, n_cold, n_warm, cold_fail, warm_fail, p90_ms, CASE WHEN n_cold < 10 THEN 'too few' WHEN c < 0.95::DOUBLE THEN CASE WHEN n_warm < 10 OR wlo > chi THEN 'failing to wake' ELSE 'failing' END WHEN cold_fail > 0 THEN 'occasional' WHEN n_cold - cold_fail >= 3 AND p90_ms > 1500 THEN 'slow' ELSE 'healthy' END AS verdict,
  n_cold >= 10 AND n_warm >= 10 AND cold_fail > 0 AND coalesce(w > c, false) AND wlo > chi AS contrast FROM hi""")
def probe_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    cold = timeline.mark_cold(domain.probes(spark, sf_dir), ["device_id"], on_bearer=F.col("net_id") != "").where("net_id <> ''")
    return devices.probe_health(cold, ["device_id"])


@query(", n AS (SELECT device_id, reg_state, reject_cause, count(*) AS n FROM regs WHERE reject_cause <> 0 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, reg_state, reject_cause) AS k FROM n) SELECT device_id, reg_state, reject_cause, n FROM r WHERE k = 1")
def dominant_failure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.dominant_failure(domain.registrations(spark, sf_dir).where("reject_cause <> 0"), ["device_id"], ["reg_state", "reject_cause"])


@query(""", w AS (SELECT *, count(*) OVER b AS n, min(wall_ms) OVER b AS lo FROM probes WHERE outcome = 'FAIL' WINDOW b AS (PARTITION BY device_id ORDER BY wall_ms RANGE BETWEEN 600000 PRECEDING AND CURRENT ROW)),
x AS (SELECT *, CASE WHEN wall_ms - lag(wall_ms) OVER (PARTITION BY device_id ORDER BY wall_ms, id) <= 90000 THEN 0 ELSE 1 END AS f FROM w WHERE n >= 3 AND wall_ms - lo >= 60000),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT device_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms, count(*) AS n FROM y GROUP BY device_id, k""")
def repeated_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    fails = domain.probes(spark, sf_dir).where("outcome = 'FAIL'")
    return devices.repeated_failures(fails, ["device_id"], "wall_ms", window=600000, least=3, span=60000, quiet=90000)


@query(""", w AS (SELECT id, rsrp, count(*) OVER b AS n, arg_min(rsrp, (wall_ms, id)) OVER b AS f FROM radio WINDOW b AS (PARTITION BY device_id ORDER BY wall_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)) SELECT id, rsrp FROM w WHERE rsrp <= -75 OR n >= 3 AND f - rsrp >= 10""")
def signal_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.decay(domain.radio(spark, sf_dir), ["device_id"], "wall_ms", "rsrp", reach=60000).select("id", "rsrp")


_THROTTLED = """, tk AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY wall_ms, id) AS k FROM {rows}), tn AS (SELECT a.device_id, a.k, min(b.k) AS nk FROM tk a JOIN tk b ON b.device_id = a.device_id AND b.k > a.k AND b.wall_ms - a.wall_ms >= {gap} GROUP BY a.device_id, a.k),
th AS (SELECT device_id, CAST(1 AS BIGINT) AS k FROM tk WHERE k = 1 UNION ALL SELECT th.device_id, tn.nk FROM th JOIN tn ON tn.device_id = th.device_id AND tn.k = th.k)"""
_WIFI = """, wf AS (SELECT device_id, id, wall_ms, id % 5 <> 0 AS validated, id % 23 = 0 AS lost, CASE WHEN id % 9 <> 0 THEN CAST(rsrp + 50 AS INT) END AS rssi FROM radio),
we AS (SELECT *, sum(lost::INT) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS epoch FROM wf),
wo AS (SELECT *, NOT lost AND coalesce(lag(CASE WHEN NOT lost THEN validated END) OVER (PARTITION BY device_id, epoch ORDER BY lost DESC, wall_ms, id) AND NOT validated, false) AS off FROM we),
wu AS (SELECT *, CASE WHEN NOT lost AND NOT off THEN rssi END AS usable FROM wo),
ww AS (SELECT *, count(usable) OVER b AS n, arg_min(usable, (wall_ms, id)) FILTER (usable IS NOT NULL) OVER b AS oldest FROM wu WINDOW b AS (PARTITION BY device_id, epoch ORDER BY wall_ms RANGE BETWEEN 60000 PRECEDING AND CURRENT ROW)),
wr AS (SELECT device_id, id, wall_ms, CASE WHEN lost THEN 'wifi-lost' WHEN off THEN 'wifi-lost-internet' WHEN n >= 3 AND oldest - usable >= 10 THEN 'wifi-falling' WHEN usable <= -75 THEN 'wifi-weak' END AS reason FROM ww),
wp AS (SELECT * FROM wr WHERE reason IS NOT NULL)"""


@query(_WIFI + _THROTTLED.format(rows="wp", gap=45000) + " SELECT tk.id, tk.reason FROM th JOIN tk ON tk.device_id = th.device_id AND tk.k = th.k")
def handover_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = domain.radio(spark, sf_dir).select("device_id", "id", "wall_ms", (i % 5 != 0).alias("validated"), (i % 23 == 0).alias("lost"), F.when(i % 9 != 0, F.col("rsrp") + 50).alias("rssi"))
    return devices.handover_predictions(rows, ["device_id"], "wall_ms", "rssi", "validated", "lost", ["wall_ms", "id"], reach=60000).select("id", "reason")


@query(", r AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY wall_ms DESC, id DESC) AS k FROM probes) SELECT device_id, id FROM r WHERE k <= 5")
def last_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.last_n(domain.probes(spark, sf_dir), ["device_id"], F.struct("wall_ms", "id").desc(), 5).select("device_id", "id")


@query("SELECT id, CAST(floor((lng + 180) / 360 * 512) AS INT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 512) AS INT) AS y FROM fixes")
def tile_xy(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = devices.tile_xy(F.col("lat"), F.col("lng"), 9)
    return domain.fixes(spark, sf_dir).select("id", x.alias("x"), y.alias("y"))


@query(""", bx(name, west, south, east, north, ordinal) AS (SELECT n_name, 103.6::DOUBLE + n_nationkey * 0.001::DOUBLE, 1.25::DOUBLE, 103.602::DOUBLE + n_nationkey * 0.001::DOUBLE, 1.28::DOUBLE, n_nationkey FROM nation)
  SELECT f.id, arg_min(b.name, b.ordinal) AS name FROM fixes f LEFT JOIN bx b ON f.lat BETWEEN b.south AND b.north AND f.lng BETWEEN b.west AND b.east GROUP BY f.id""")
def locate_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    boxes = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("name"), (F.lit(103.6) + k * 0.001).alias("west"), F.lit(1.25).alias("south"), (F.lit(103.602) + k * 0.001).alias("east"), F.lit(1.28).alias("north"), k.alias("ordinal"))
    return devices.locate_boxes(domain.fixes(spark, sf_dir), boxes, "lat", "lng").select("id", "name")


@query(""", x AS (SELECT *, CASE WHEN row_number() OVER w = 1 OR lag(band) OVER w IS DISTINCT FROM band THEN 1 ELSE 0 END AS f FROM radio WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT device_id, band, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms FROM y GROUP BY device_id, band, k HAVING max(wall_ms) - min(wall_ms) >= 30000""")
def dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.held(domain.radio(spark, sf_dir), ["device_id"], "wall_ms", "band", ["wall_ms", "id"], 30000)


_STATE = """, ab AS (SELECT device_id, id, wall_ms, row_number() OVER w AS k, count(*) OVER b AS n, count(*) FILTER (sinr < 0) OVER b AS bad FROM radio WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id), b AS (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING)),
ag AS (SELECT a.device_id, a.id, a.wall_ms, a.k, a.n - coalesce(max(o.n), 0) AS n, a.bad - coalesce(max(o.bad), 0) AS bad FROM ab a LEFT JOIN ab o ON o.device_id = a.device_id AND o.wall_ms < a.wall_ms - 600000 GROUP BY a.device_id, a.id, a.wall_ms, a.k, a.n, a.bad),
st AS (SELECT device_id, k, id, n >= 5 AND bad >= 0.7::DOUBLE * n AS poor, CASE WHEN n >= 5 AND bad >= 0.7::DOUBLE * n THEN wall_ms END AS since FROM ag WHERE k = 1
  UNION ALL SELECT g.device_id, g.k, g.id, st.poor <> (n >= 5 AND (since IS NULL OR wall_ms - since >= 120000) AND (NOT st.poor AND CAST(bad AS DOUBLE) / n >= 0.7 OR st.poor AND CAST(bad AS DOUBLE) / n <= 0.3)),
    CASE WHEN n >= 5 AND (since IS NULL OR wall_ms - since >= 120000) AND (NOT st.poor AND CAST(bad AS DOUBLE) / n >= 0.7 OR st.poor AND CAST(bad AS DOUBLE) / n <= 0.3) THEN wall_ms ELSE since END FROM st JOIN ag g ON g.device_id = st.device_id AND g.k = st.k + 1)"""


@query(_STATE + " SELECT id, poor FROM st")
def area_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.radio(spark, sf_dir).select("device_id", "id", "wall_ms", (F.col("sinr") < 0).alias("bad"))
    return devices.area_state(rows, ["device_id"], "wall_ms", "bad", ["wall_ms", "id"], least=5, dwell=120000).select("id", "poor")


_THIN = ", fc AS (SELECT device_id, id, wall_ms, " + hex_sql("lat", "lng", 9) + """ AS cell FROM fixes), fl2 AS (SELECT *, coalesce(lag(cell) OVER w <> cell, true) AS fresh, coalesce(lead(cell) OVER w <> cell, false) AS edge FROM fc WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
fr2 AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS run FROM fl2), tk AS (SELECT *, row_number() OVER (PARTITION BY device_id, run ORDER BY wall_ms, id) AS k FROM fr2),
tn AS (SELECT a.device_id, a.run, a.k, min(b.k) AS nk FROM tk a JOIN tk b ON b.device_id = a.device_id AND b.run = a.run AND b.k > a.k AND b.wall_ms - a.wall_ms >= 60000 GROUP BY ALL),
th AS (SELECT device_id, run, CAST(1 AS BIGINT) AS k FROM tk WHERE k = 1 UNION ALL SELECT th.device_id, th.run, tn.nk FROM th JOIN tn ON tn.device_id = th.device_id AND tn.run = th.run AND tn.k = th.k)"""


@query(_THIN + " SELECT tk.device_id, tk.id, tk.wall_ms, tk.cell FROM tk LEFT JOIN th ON th.device_id = tk.device_id AND th.run = tk.run AND th.k = tk.k WHERE edge OR th.k IS NOT NULL")
def thin_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = domain.fixes(spark, sf_dir).withColumn("cell", hexgrid.cell_of(F.col("lat"), F.col("lng"), 9))
    return devices.thin(f.select("device_id", "id", "wall_ms", "cell"), ["device_id"], "wall_ms", "cell", ["wall_ms", "id"])


@query(""", lt AS (SELECT device_id, max(wall_ms) FILTER (sinr >= 0) AS signal_ms, max(wall_ms) FILTER (rat = 'LTE') AS cell_ms FROM radio GROUP BY device_id), ls AS (SELECT device_id, max(wall_ms) AS service_ms FROM regs GROUP BY device_id)
  SELECT device_id, signal_ms, service_ms, cell_ms, coalesce(2592000 - signal_ms > 15000, true) AS signal_stale, coalesce(2592000 - service_ms > 600000, true) AS service_stale, coalesce(2592000 - cell_ms > 120000, true) AS cell_stale FROM lt LEFT JOIN ls USING (device_id)""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = lambda c: F.max(F.when(c, F.col("wall_ms")))
    latest = domain.radio(spark, sf_dir).groupBy("device_id").agg(last(F.col("sinr") >= 0).alias("signal_ms"), last(F.col("rat") == "LTE").alias("cell_ms"))
    service = domain.registrations(spark, sf_dir).groupBy("device_id").agg(F.max("wall_ms").alias("service_ms"))
    return devices.freshness(latest.join(service, "device_id", "left"), F.lit(2592000))


_CONFIRMED = """, kn AS (SELECT * FROM vals WHERE v IS NOT NULL), cx AS (SELECT *, CASE WHEN lag(v) OVER w = v THEN 0 ELSE 1 END AS f FROM kn WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
cy AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM cx), cz AS (SELECT *, min(wall_ms) OVER (PARTITION BY device_id, k) AS since_ms FROM cy),
cf AS (SELECT device_id, k, v, since_ms, min(wall_ms) AS at_ms FROM cz WHERE wall_ms - since_ms >= {dwell} GROUP BY ALL), cg AS (SELECT *, lag(v) OVER (PARTITION BY device_id ORDER BY k) AS was FROM cf)"""


@query(", vals AS (SELECT *, CAST(floor(lat / 0.001::DOUBLE) AS BIGINT) || '_' || CAST(floor(lng / 0.001::DOUBLE) AS BIGINT) AS v FROM fixes)" + _CONFIRMED.format(dwell=20000) + " SELECT device_id, v AS square, since_ms, at_ms FROM cg WHERE was IS DISTINCT FROM v")
def grid_dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of the grid that a device stayed in."""
    f = domain.fixes(spark, sf_dir).withColumn("square", devices.grid_cell(F.col("lat"), F.col("lng"), 0.001))
    return devices.confirmed(f, ["device_id"], "wall_ms", "square", ["wall_ms", "id"], 20000)


@query(", vals AS (SELECT *, CASE WHEN id % 5 <> 0 THEN CASE WHEN id % 7 < 5 THEN 'SG' ELSE 'MY' END END AS v FROM radio)" + _CONFIRMED.format(dwell=60000) + " SELECT device_id, v AS country, since_ms, at_ms FROM cg WHERE was IS DISTINCT FROM v")
def country_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Countries that the network reports for long enough, one after another."""
    rows = domain.radio(spark, sf_dir).withColumn("country", F.when(F.col("id") % 5 != 0, F.when(F.col("id") % 7 < 5, "SG").otherwise("MY")))
    return devices.confirmed(rows, ["device_id"], "wall_ms", "country", ["wall_ms", "id"], 60000)


_TEXTS = ["PDP_ADDRESS_REJECTED", "unknown", "SLAAC timeout", "INSUFFICIENT_RESOURCES", "Error_Unspecified"]


@query(", ct AS (SELECT device_id, (" + str(_TEXTS) + """)[reject_cause % 5 + 1] AS cause, count(*) AS n FROM regs WHERE reject_cause <> 0 GROUP BY ALL), cr AS (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY n DESC, cause) AS k FROM ct)
  SELECT device_id, cause, n, CASE WHEN regexp_matches(upper(cause), 'IPV6|RS_RA|SLAAC|ADDRESS') THEN 'IPV6_CONFIG_FAILURE' WHEN regexp_matches(upper(cause), 'UNSPECIFIED|UNKNOWN') THEN 'UNKNOWN' ELSE 'REPEATED_SETUP_FAILURE' END AS kind FROM cr WHERE k = 1""")
def fault_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dominant cause of failures per device, and the kind of fault that its text tells."""
    text = F.get(F.array(*map(F.lit, _TEXTS)), F.col("reject_cause") % 5)
    rows = domain.registrations(spark, sf_dir).where("reject_cause <> 0").withColumn("cause", text)
    return devices.dominant_failure(rows, ["device_id"], ["cause"]).withColumn("kind", devices.fault_kind(F.col("cause")))


_CONNECTIONS = ", cn AS (SELECT device_id, sub_id, id, 2 * wall_ms AS t, CASE WHEN event_type IN ('click', 'purchase') THEN 'CONNECTED' WHEN event_type IN ('view', 'error') THEN 'DISCONNECTED' ELSE 'SUSPENDED' END AS state FROM e)" + """,
sv AS (SELECT cn.device_id, cn.sub_id, cn.id, t, state, arg_max(reg_state, (r.wall_ms, r.id)) AS reg FROM cn LEFT JOIN regs r ON r.device_id = cn.device_id AND r.sub_id = cn.sub_id AND 2 * r.wall_ms <= t GROUP BY ALL),
dn AS (SELECT *, lag(state) OVER w AS was, sum((state = 'DISCONNECTED')::INT) OVER (PARTITION BY device_id, sub_id ORDER BY t, id ROWS UNBOUNDED PRECEDING) - (state = 'DISCONNECTED')::INT AS part FROM sv WINDOW w AS (PARTITION BY device_id, sub_id ORDER BY t, id)),
sn AS (SELECT *, min(t) FILTER (state = 'CONNECTED') OVER (PARTITION BY device_id, sub_id, part ORDER BY t, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM dn),
fl AS (SELECT device_id, sub_id, id, t FROM sn WHERE state = 'DISCONNECTED' AND coalesce(was, '') <> 'DISCONNECTED' AND coalesce(t - since, 0) < 120000 AND coalesce(reg = 'IN_SERVICE', true))"""


def _short_lived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as connections and disconnections of each subscription, with the state of service that was last reported."""
    keys, kind = ["device_id", "sub_id"], F.col("event_type")
    t = (F.col("wall_ms") * 2).alias("t")
    rows = domain.events(spark, sf_dir).select(*keys, "id", t, F.when(kind.isin("click", "purchase"), "CONNECTED").when(kind.isin("view", "error"), "DISCONNECTED").otherwise("SUSPENDED").alias("state"))
    service = domain.registrations(spark, sf_dir).groupBy(*keys, t).agg((F.max_by("reg_state", "id") == "IN_SERVICE").alias("in_service"))
    return faults.short_lived(timeline.asof_join(rows, service, keys, "t", ["in_service"]), keys, "t", "state", "in_service", ["id"]).select(*keys, "id", "t")


@query(_CONNECTIONS + " SELECT * FROM fl")
def short_lived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short_lived(spark, sf_dir)


@query(_CONNECTIONS + f""", fw AS (SELECT *, count(*) OVER b AS n_in, min(t) OVER b AS first, count(*) OVER (PARTITION BY device_id, sub_id ORDER BY t RANGE UNBOUNDED PRECEDING) AS place, least(lag(t, 5) OVER (PARTITION BY device_id, sub_id ORDER BY t, id), max(t) OVER (PARTITION BY device_id, sub_id ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 300000 PRECEDING)) AS needed
  FROM fl WINDOW b AS (PARTITION BY device_id, sub_id ORDER BY t RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW)),
xt AS (SELECT device_id, sub_id, 2 * wall_ms AS t, max(reject_cause % 9) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms RANGE UNBOUNDED PRECEDING) AS told, ({_TEXTS})[reject_cause % 5 + 1] AS cause FROM regs),
iv AS (SELECT device_id, sub_id, t AS f, greatest(needed + 3600000, t + 900000) AS u, first, place - n_in AS before, place AS through, NULL::BIGINT AS told, NULL::VARCHAR AS cause FROM fw WHERE n_in >= 6 AND t - first >= 300000 UNION ALL SELECT device_id, sub_id, t, t + 1200000, t, NULL, NULL, told, cause FROM xt WHERE told >= 6),
jn AS (SELECT *, coalesce(f > max(u) OVER (PARTITION BY device_id, sub_id ORDER BY f, u ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)::INT AS new FROM iv), kf AS (SELECT *, sum(new) OVER (PARTITION BY device_id, sub_id ORDER BY f, u ROWS UNBOUNDED PRECEDING) AS k FROM jn),
ft AS (SELECT device_id, sub_id, arg_min(first, (f, first)) AS first_ms, max(f) AS last_ms, max(u) AS u, CAST(greatest(coalesce(max(through) - arg_min(before, (f, before)) FILTER (through IS NOT NULL), 0), coalesce(max(told), 0), 1) AS BIGINT) AS n, arg_max(cause, (f, cause)) FILTER (cause IS NOT NULL) AS cause, max(f) FILTER (cause IS NOT NULL) AS ev FROM kf GROUP BY device_id, sub_id, k),
fz AS (SELECT *, CASE WHEN last_ms - ev <= 1200000 THEN upper(cause) END AS c, CASE WHEN u < 5184000 THEN u END AS cleared_ms FROM ft)
SELECT device_id, sub_id, first_ms, last_ms, n, cause, CASE WHEN regexp_matches(c, 'IPV6|RS_RA|SLAAC|ADDRESS') THEN 'IPV6_CONFIG_FAILURE' WHEN regexp_matches(c, 'UNSPECIFIED|UNKNOWN') THEN 'UNKNOWN' ELSE 'REPEATED_SETUP_FAILURE' END AS kind, cleared_ms FROM fz WHERE cleared_ms IS NULL OR 5184000 - cleared_ms <= 86400000""")
def carrier_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults by short-lived connections and by what registrations tell from outside."""
    text = F.get(F.array(*map(F.lit, _TEXTS)), F.col("reject_cause") % 5)
    told = domain.registrations(spark, sf_dir).select("device_id", "sub_id", (F.col("wall_ms") * 2).alias("t"), (F.col("reject_cause") % 9).alias("told"), text.alias("cause"))
    return faults.carrier_faults(_short_lived(spark, sf_dir), told, ["device_id", "sub_id"], "t", 5184000, ["id"])


_FAULTS = SQL["repeated_failures"].split("WITH RECURSIVE", 1)[1].split(domain.SQL, 1)[1].rsplit(" SELECT device_id, min(wall_ms)", 1)[0]


@query(_FAULTS + """, ff AS (SELECT device_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms, count(*) AS n FROM y GROUP BY device_id, k)
  SELECT *, 2592000 - end_ms < 300000 AS active, row_number() OVER (PARTITION BY device_id ORDER BY 2592000 - end_ms < 300000 DESC, end_ms DESC) AS place FROM ff WHERE 2592000 - end_ms <= 1800000""")
def order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return devices.order_faults(repeated_failures(spark, sf_dir), ["device_id"], F.lit(2592000), quiet=300000, forget=1800000)


# ---- sources and sinks ----------------------------------------------------------------------------------------------------


@query(""", old AS (SELECT device_id, band, count(*) AS n, max(wall_ms) AS last_ms FROM radio WHERE id % 2 = 0 GROUP BY ALL), new AS (SELECT device_id, band, count(*) AS n, max(wall_ms) AS last_ms FROM radio WHERE id % 2 = 1 GROUP BY ALL)
  SELECT device_id, band, CAST(sum(n) AS BIGINT) AS n, max(last_ms) AS last_ms FROM (SELECT * FROM old UNION ALL SELECT * FROM new) u GROUP BY device_id, band""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: domain.radio(spark, sf_dir).where(F.col("id") % 2 == k).groupBy("device_id", "band").agg(F.count("*").alias("n"), F.max("wall_ms").alias("last_ms"))
    return tables.upsert_merge(part(0), part(1), ["device_id", "band"], {"n": F.sum("n"), "last_ms": F.max("last_ms")})


_UPLOADS = ", up AS (SELECT id, wall_ms, CASE WHEN id % 7 <> 0 THEN md5(CAST(device_id % 40 AS VARCHAR)) END AS submission, CASE WHEN id % 11 = 0 THEN md5(CAST((device_id + 1) % 40 AS VARCHAR)) END AS retire FROM links)"


@query(_UPLOADS + """, nw AS (SELECT *, row_number() OVER (PARTITION BY submission ORDER BY wall_ms DESC, CAST(id AS VARCHAR) DESC) AS r FROM up WHERE submission IS NOT NULL),
rt AS (SELECT retire, max(wall_ms) AS t FROM up WHERE submission IS NOT NULL AND retire IS NOT NULL GROUP BY retire)
SELECT id FROM nw WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM rt WHERE rt.retire = nw.submission AND nw.wall_ms < rt.t) UNION ALL SELECT id FROM up WHERE submission IS NULL""")
def latest_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = F.col("device_id"), F.col("id")
    up = domain.links(spark, sf_dir).select("id", F.col("wall_ms").alias("arrived_ms"), i.cast("string").alias("path"), F.when(i % 7 != 0, F.md5((d % 40).cast("string").cast("binary"))).alias("submission"), F.when(i % 11 == 0, F.md5(((d + 1) % 40).cast("string").cast("binary"))).alias("retire"))
    return bundles.latest_submissions(up).select("id")


@query("SELECT CAST(c_custkey % 900 + 100 AS VARCHAR) || '-' || CAST(c_custkey % 90 + 10 AS VARCHAR) AS plmn, arg_min(c_name, (c_mktsegment <> 'BUILDING', c_custkey)) AS name FROM customer GROUP BY 1")
def build_plmn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    rows = c.select((k % 900 + 100).cast("string").alias("mcc"), (k % 90 + 10).cast("string").alias("mnc"), F.lit("").alias("brand"), F.col("c_name").alias("operator"), F.when(F.col("c_mktsegment") == "BUILDING", "Operational").otherwise("Other").alias("status"), F.lit("").alias("country"), k.alias("ordinal"))
    return tables.build_plmn_names(rows).select("plmn", "name")


@query("SELECT r.id, coalesce(n.c_name, r.plmn) AS network_name FROM radio r LEFT JOIN (SELECT '525-0' || (c_custkey + 1) AS plmn, c_name FROM customer) n ON n.plmn = r.plmn")
def network_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("525-0"), (F.col("c_custkey") + 1).cast("string")).alias("plmn"), F.col("c_name").alias("name"))
    return tables.network_name(domain.radio(spark, sf_dir), "plmn", [names]).select("id", "network_name")


_NAMED = """, codes AS (SELECT id, CAST(id % 1100 + 1 AS BIGINT) AS k FROM radio), cd AS (SELECT id, CAST(k % 900 + 100 AS VARCHAR) || '-' || CAST(k % 90 + 10 AS VARCHAR) AS plmn FROM codes),
listed AS (SELECT CAST(c_custkey % 900 + 100 AS VARCHAR) || '-' || CAST(c_custkey % 90 + 10 AS VARCHAR) AS plmn, arg_min(c_name, (c_mktsegment <> 'BUILDING', c_custkey)) AS name FROM customer GROUP BY 1),
curated AS (SELECT plmn, 'curated ' || name AS name FROM listed WHERE hash_of(plmn) % 3 = 0), learned AS (SELECT plmn, 'learned ' || name AS name FROM listed WHERE hash_of(plmn) % 2 = 0)
SELECT cd.id, coalesce(c.name, l.name, t.name, cd.plmn) AS network_name FROM cd LEFT JOIN curated c ON c.plmn = cd.plmn LEFT JOIN learned l ON l.plmn = cd.plmn LEFT JOIN listed t ON t.plmn = cd.plmn""".replace("hash_of(plmn)", "CAST(left(plmn, 3) AS INT)")


@query(_NAMED)
def network_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by precedence (curated, learned, listed) from tables of all customers."""
    k, code = F.col("id") % 1100 + 1, F.left("plmn", F.lit(3)).cast("int")
    rows = domain.radio(spark, sf_dir).select("id", F.concat((k % 900 + 100).cast("string"), F.lit("-"), (k % 90 + 10).cast("string")).alias("plmn"))
    listed = build_plmn_names(spark, sf_dir)
    some = lambda kind, n: listed.where(code % n == 0).select("plmn", F.concat(F.lit(f"{kind} "), "name").alias("name"))
    return tables.network_name(rows, "plmn", [some("curated", 3), some("learned", 2), listed]).select("id", "network_name")


@query("SELECT id FROM radio WHERE device_id NOT IN (SELECT device_id FROM regs WHERE reject_cause = 16)")
def erase_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.erase_devices(domain.radio(spark, sf_dir), domain.registrations(spark, sf_dir).where("reject_cause = 16")).select("id")


@query(f", fc AS (SELECT {hex_sql('lat', 'lng', 9)} AS cell, count(*) AS n FROM fixes GROUP BY 1) SELECT {feature_sql('cell', 9, {'n': True})} AS feature FROM fc")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = domain.fixes(spark, sf_dir).withColumn("cell", hexgrid.cell_of(F.col("lat"), F.col("lng"), 9))
    return tables.to_geojson(f.groupBy("cell").agg(F.count("*").alias("n")), "cell", ["n"])


@query("SELECT DISTINCT plmn FROM radio WHERE wall_ms >= 2000000 UNION SELECT DISTINCT plmn FROM radio WHERE wall_ms < 2000000 AND plmn LIKE '525-%'")
def known_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = domain.radio(spark, sf_dir)
    return r.where("wall_ms >= 2000000").select("plmn").union(r.where("wall_ms < 2000000 and startswith(plmn, '525-')").select("plmn")).distinct()
