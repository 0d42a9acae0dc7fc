"""Queries of the rules on readings, probes, reports and roll-up streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..functions import hexgrid, radio
from ..operators import incidents, rollup, signals, timeline
from .core import _COLD, _round, hex_sql
from .incidents import _TOP, _features
from .registry import query

#: Readings beside those of the domain, in SQL that both engines read.
READINGS = {
    "lte_rsrp": "CAST(CASE WHEN id % 6 = 0 THEN 2147483647 WHEN id % 29 = 0 THEN -140 WHEN id % 31 = 0 THEN -43 ELSE rsrp END AS INT)", "rsrq": "CAST(CASE WHEN id % 23 = 0 THEN -34 ELSE -20 + id * 31 % 20 END AS INT)", "lte_snr": "CAST(CASE WHEN id % 10 = 0 THEN 2147483647 ELSE sinr END AS INT)",
    "ta": "CAST(CASE WHEN id % 3 <> 0 THEN id * 13 % 1400 END AS INT)", "cqi": "CAST(CASE WHEN id % 4 <> 0 THEN id % 18 END AS INT)", "nr_rsrp": "CAST(CASE WHEN id % 5 = 4 THEN -44 - id * 17 % 90 ELSE 2147483647 END AS INT)", "nr_snr": "CAST(CASE WHEN id % 10 = 4 THEN id % 64 - 23 ELSE 2147483647 END AS INT)",
    "cell_age_ms": "id * 977 % 200000", "band_reported": "CAST(CASE WHEN id % 5 <> 0 THEN id % 7 % 3 + 1 END AS INT)", "band_derived": "CAST(CASE WHEN id % 11 = 0 THEN 40 ELSE id % 7 % 3 + 1 END AS INT)", "withheld": "id % 37 = 0",
}
_READ = ", rd0 AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in READINGS.items()) + " FROM radio)"


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.radio(spark, sf_dir).selectExpr("*", *[f"{v} AS {k}" for k, v in READINGS.items()])


_LIVE = _READ + """, rd1 AS (SELECT * EXCLUDE (lte_rsrp, lte_snr, nr_rsrp, nr_snr), nullif(lte_rsrp, 2147483647) AS lte_rsrp, nullif(lte_snr, 2147483647) AS lte_snr, nullif(nr_rsrp, 2147483647) AS nr_rsrp, nullif(nr_snr, 2147483647) AS nr_snr FROM rd0)"""


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.normalise_signal(readings(spark, sf_dir), {"rsrp": "lte_rsrp", "snr": "lte_snr", "cqi": "cqi"}, {"rsrp": "nr_rsrp", "snr": "nr_snr"})


@query(_LIVE + " SELECT id, lte_rsrp, lte_snr, coalesce(lte_rsrp, nr_rsrp) AS live_rsrp, coalesce(lte_snr, nr_snr) AS live_snr, cqi AS live_cqi, nr_rsrp IS NOT NULL OR nr_snr IS NOT NULL AS nr_present FROM rd1")
def normalise_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).select("id", "lte_rsrp", "lte_snr", "live_rsrp", "live_snr", "live_cqi", "nr_present")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = live(spark, sf_dir).withColumns({"rsrp": F.col("lte_rsrp"), "rssnr": F.col("lte_snr"), "ss_rsrp": F.col("nr_rsrp"), "ss_sinr": F.col("nr_snr"), "ss_rsrq": F.lit(None).cast("int"), "pci": F.lit(None).cast("int"), "band_ambiguous": F.col("id") % 13 == 0})
    return signals.quality_flags(rows)


_FLAGGED = _LIVE + """, fg0 AS (SELECT id, device_id, sub_id, wall_ms, plmn, rat, band, (coalesce(lte_rsrp = -140 OR lte_rsrp = -43, false))::INT + 2 * (rsrq = -34 OR rsrq = 3)::INT + 4 * coalesce(lte_snr = -20 OR lte_snr = 30, false)::INT + 8 * coalesce(ta < 0 OR ta > 1282, false)::INT + 16 * coalesce(cqi < 0 OR cqi > 15, false)::INT
  + 32 * (cell_age_ms > 120000)::INT + 64 * (coalesce(nr_rsrp = -140 OR nr_rsrp = -44, false) OR coalesce(nr_snr = -23 OR nr_snr = 40, false))::INT + 128 * (id % 13 = 0)::INT + 256 * coalesce(band_reported <> band_derived, false)::INT + 512 * withheld::INT AS flags FROM rd1)"""


@query(_FLAGGED + " SELECT id, CAST(flags AS INT) AS flags FROM fg0")
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagged(spark, sf_dir).select("id", "flags")


@query(_FLAGGED + ", fb0 AS (SELECT device_id, unnest(range(0, 10)) AS bit, flags FROM fg0) SELECT device_id, CAST(bit AS INT) AS bit, count(*) AS n FROM fb0 WHERE (flags // CAST(pow(2, bit) AS BIGINT)) % 2 = 1 GROUP BY ALL")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each flag is set, per device."""
    return rollup.bit_counts(flagged(spark, sf_dir), ["device_id"], "flags", len(signals.FLAGS))


@query(", eb AS (SELECT id, CASE WHEN id % 3 = 0 THEN band END AS s, CASE WHEN id % 2 = 0 THEN band + 10 END AS d, CASE WHEN id % 5 <> 0 THEN band + 20 END AS r FROM radio) SELECT id, CAST(coalesce(s, d, r) AS INT) AS band_used, CASE WHEN s IS NOT NULL THEN 'LTE' WHEN d IS NOT NULL THEN 'NR' END AS band_rat FROM eb")
def effective_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = domain.radio(spark, sf_dir).select("id", F.when(i % 3 == 0, F.col("band")).alias("stored_band"), F.when(i % 2 == 0, F.col("band") + 10).alias("derived_band"), F.when(i % 5 != 0, F.col("band") + 20).alias("raw_band"), F.lit("LTE").alias("stored_rat"), F.lit("NR").alias("derived_rat"))
    return signals.effective_band(rows).select("id", "band_used", "band_rat")


_REPORTS = """, nr0 AS (SELECT id, wall_ms, CASE WHEN id % 17 = 0 THEN '52501' ELSE plmn END AS plmn, CASE id % 7 WHEN 0 THEN plmn WHEN 1 THEN '525 01' WHEN 2 THEN 'Home' WHEN 3 THEN NULL WHEN 4 THEN 'A name that is longer than thirty-two' ELSE ' Net ' || (id % 4) END AS reported, '525-1' AS sim_plmn, 'home' AS sim_name FROM radio)"""


@query(_REPORTS + """, nr1 AS (SELECT *, replace(trim(plmn), '-0', '-') AS k, trim(coalesce(reported, '')) AS n FROM nr0)
SELECT k AS plmn, arg_max(n, (wall_ms, id)) AS name FROM nr1 WHERE contains(plmn, '-') AND length(n) BETWEEN 1 AND 32 AND NOT regexp_matches(n, '^[0-9 -]+$') AND lower(n) <> lower(plmn) AND NOT (lower(n) = 'home' AND k <> '525-1') AND k <> '525-3' GROUP BY k""")
def learn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    r = domain.radio(spark, sf_dir).select("id", "wall_ms", F.when(i % 17 == 0, "52501").otherwise(F.col("plmn")).alias("plmn"), F.when(i % 7 == 0, F.col("plmn")).when(i % 7 == 1, "525 01").when(i % 7 == 2, "Home").when(i % 7 == 4, "A name that is longer than thirty-two").when(i % 7 > 4, F.concat(F.lit(" Net "), (i % 4).cast("string"))).alias("reported"), F.lit("525-1").alias("sim_plmn"), F.lit("home").alias("sim_name"))
    return signals.learn_names(r, ["wall_ms", "id"], r.select(F.lit("525-03").alias("plmn")).limit(1))


# ---- probes -------------------------------------------------------------------------------------------------------------

PROBE_TYPE = "CASE id % 12 WHEN 0 THEN 'BINDFAIL' WHEN 1 THEN 'NOBEARER' WHEN 2 THEN 'STALL' WHEN 3 THEN 'UP8K' WHEN 4 THEN 'DOWN8K' WHEN 5 THEN 'DNS' WHEN 6 THEN 'TCP4' WHEN 7 THEN 'PING' ELSE 'TLS' END"
ERROR = "CASE WHEN outcome = 'FAIL' THEN CASE id % 5 WHEN 0 THEN 'Binding socket: EPERM' WHEN 1 THEN 'no cellular network' WHEN 2 THEN 'timeout: 6000 ms' WHEN 3 THEN NULL ELSE ' refused ' END END"
_TYPED = f""", pt0 AS (SELECT *, {PROBE_TYPE} AS probe_type, {ERROR} AS error FROM cold), pt1 AS (SELECT *, CASE WHEN contains(coalesce(error, ''), 'Binding socket') THEN 'INSTRUMENT' WHEN contains(coalesce(error, ''), 'no cellular network') THEN 'NO_BEARER'
  ELSE CASE substr(probe_type, 1, 2) WHEN 'BI' THEN 'INSTRUMENT' WHEN 'NO' THEN 'NO_BEARER' WHEN 'ST' THEN 'RECOVERY' WHEN 'UP' THEN 'TRANSFER' WHEN 'DO' THEN 'TRANSFER' WHEN 'PI' THEN 'UNKNOWN' ELSE 'REACHABILITY' END END AS kind FROM pt0)"""


def typed_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    cold = timeline.mark_cold(domain.probes(spark, sf_dir), ["device_id"], on_bearer=F.col("net_id") != "").withColumn("on_bearer", F.col("net_id") != "")
    return cold.selectExpr("*", f"{PROBE_TYPE} AS probe_type", f"{ERROR} AS error").withColumn("kind", signals.probe_kind(F.col("probe_type"), F.col("error")))


@query(_COLD + _TYPED + " SELECT id, kind, kind IN ('INSTRUMENT', 'RECOVERY', 'NO_BEARER') AS excluded, CASE WHEN error IS NULL THEN 'unspecified' ELSE trim(split_part(error, ':', 1)) END AS reason FROM pt1")
def probe_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = typed_probes(spark, sf_dir)
    return p.select("id", "kind", signals.excluded_from_rates(F.col("kind")).alias("excluded"), radio.normalise_error(F.col("error")).alias("reason"))


_TALLY = _COLD + _TYPED + """, ta AS (SELECT *, net_id <> '' AS ob, kind NOT IN ('INSTRUMENT', 'RECOVERY', 'NO_BEARER') AND net_id <> '' AS c FROM pt1),
te AS (SELECT device_id, CASE WHEN error IS NULL THEN 'unspecified' ELSE trim(split_part(error, ':', 1)) END AS e, count(*) AS n FROM ta WHERE c AND outcome <> 'OK' GROUP BY ALL), tt AS (SELECT device_id, arg_min(e, (-n, e)) AS top_error, max(n) AS top_error_n FROM te GROUP BY device_id),
tg AS (SELECT device_id, count(*) FILTER (c) AS probe_n, count(*) FILTER (c AND outcome <> 'OK') AS probe_fail, count(*) FILTER (kind = 'INSTRUMENT') AS instrument_n, count(*) FILTER (kind = 'NO_BEARER' OR kind NOT IN ('INSTRUMENT', 'RECOVERY') AND NOT ob) AS no_bearer_n,
  count(*) FILTER (c AND cold) AS cold_n, count(*) FILTER (c AND cold AND outcome <> 'OK') AS cold_fail FROM ta GROUP BY device_id)"""


@query(_TALLY + " SELECT tg.*, top_error, top_error_n FROM tg LEFT JOIN tt USING (device_id)")
def probe_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.probe_tallies(typed_probes(spark, sf_dir), ["device_id"])


@query(_COLD + _TYPED + """, ih AS (SELECT device_id, count(*) AS n, count(*) FILTER (kind = 'INSTRUMENT') AS i, count(*) FILTER (kind = 'NO_BEARER') AS b FROM pt1 WHERE wall_ms > 2592000 - 1200000 GROUP BY device_id),
ic AS (SELECT device_id, 'c' || (id % 3) AS chk, arg_max(CASE id % 11 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 0 ELSE 1 END, (wall_ms, id)) AS lv FROM regs GROUP BY ALL), iw AS (SELECT device_id, max(lv) AS lv FROM ic GROUP BY device_id),
al AS (SELECT device_id FROM probes UNION SELECT device_id FROM iw),
il AS (SELECT al.device_id, coalesce(n - b, 0) AS tests, coalesce(i, 0) AS instrument_n, coalesce(b, 0) AS no_bearer_n, CASE WHEN coalesce(n - b, 0) > 0 AND i > 0.25::DOUBLE * (n - b) THEN 3 WHEN coalesce(n - b, 0) <= 0 AND coalesce(b, 0) > 0 THEN 2 WHEN coalesce(n, 0) = 0 THEN 0 ELSE 1 END AS pl, coalesce(lv, 0) AS lv FROM al LEFT JOIN ih USING (device_id) LEFT JOIN iw USING (device_id))
SELECT device_id, tests, instrument_n, no_bearer_n, (['UNKNOWN', 'OK', 'DEGRADED', 'BROKEN'])[pl + 1] AS probe_level, (['UNKNOWN', 'OK', 'DEGRADED', 'BROKEN'])[greatest(pl, lv) + 1] AS worst FROM il""")
def instrument_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    checks = domain.registrations(spark, sf_dir).select("device_id", "id", "wall_ms", F.concat(F.lit("c"), (i % 3).cast("string")).alias("check"), F.when(i % 11 == 0, "BROKEN").when(i % 11 == 1, "DEGRADED").when(i % 11 == 2, "UNKNOWN").otherwise("OK").alias("level"))
    return signals.instrument_health(typed_probes(spark, sf_dir), checks, ["device_id"], 2592000)


# ---- reports --------------------------------------------------------------------------------------------------------------


@query(""", ns AS (SELECT device_id, sub_id, wall_ms, max(id) AS id FROM radio GROUP BY ALL), nx AS (SELECT ns.*, r.ci, r.rat AS srat FROM ns JOIN radio r ON r.id = ns.id),
rp AS (SELECT *, coalesce(lag(ci) OVER w <> ci, true) AS fresh FROM nx WINDOW w AS (PARTITION BY device_id, sub_id ORDER BY wall_ms)), rr AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms ROWS UNBOUNDED PRECEDING) AS run FROM rp),
tk AS (SELECT *, row_number() OVER (PARTITION BY device_id, sub_id, run ORDER BY wall_ms) AS k FROM rr), tn AS (SELECT a.device_id, a.sub_id, a.run, a.k, min(b.k) AS nk FROM tk a JOIN tk b ON b.device_id = a.device_id AND b.sub_id = a.sub_id AND b.run = a.run AND b.k > a.k AND b.wall_ms - a.wall_ms >= 60000 GROUP BY ALL),
th AS (SELECT device_id, sub_id, run, CAST(1 AS BIGINT) AS k FROM tk WHERE k = 1 UNION ALL SELECT th.device_id, th.sub_id, th.run, tn.nk FROM th JOIN tn ON tn.device_id = th.device_id AND tn.sub_id = th.sub_id AND tn.run = th.run AND tn.k = th.k),
wr AS (SELECT tk.* FROM tk JOIN th ON th.device_id = tk.device_id AND th.sub_id = tk.sub_id AND th.run = tk.run AND th.k = tk.k),
ce AS (SELECT *, CAST(id * 8 + j AS INT) % 504 AS pci, CAST(-60 - (id * 31 + j * 17) % 80 AS INT) AS crsrp, CASE WHEN (id + j) % 4 = 0 THEN 'NR' ELSE 'LTE' END AS crat, (id + j) % 9 = 0 AS secondary, j = 0 OR (id + j) % 7 = 0 AS registered FROM (SELECT *, unnest(range(0, 9)) AS j FROM wr) x),
rk AS (SELECT *, row_number() OVER (PARTITION BY device_id, sub_id, wall_ms ORDER BY crsrp DESC, pci) AS place FROM ce WHERE NOT secondary AND (NOT registered OR crat = 'NR' AND srat <> 'NR'))
SELECT device_id, sub_id, wall_ms, CAST(pci AS INT) AS pci, crsrp AS rsrp, CAST(place AS INT) AS place FROM rk WHERE place <= 6""")
def top_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, j = F.col("id"), F.col("j")
    own = domain.radio(spark, sf_dir).groupBy("device_id", "sub_id", "wall_ms").agg(F.max_by(F.struct("id", F.col("ci").alias("serving"), F.col("rat").alias("serving_rat")), "id").alias("x")).select("device_id", "sub_id", "wall_ms", "x.*")
    cells = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(8)))).withColumns({"pci": ((i * 8 + j) % 504).cast("int"), "rsrp": (-60 - (i * 31 + j * 17) % 80).cast("int"), "rat": F.when((i + j) % 4 == 0, "NR").otherwise("LTE"), "secondary": (i + j) % 9 == 0, "registered": (j == 0) | ((i + j) % 7 == 0)})
    return signals.top_neighbours(cells, ["device_id", "sub_id"], "wall_ms", "serving").select("device_id", "sub_id", "wall_ms", "pci", "rsrp", "place")


@query(""", cr AS (SELECT device_id, sub_id, id % 3 AS tier, arg_max(id % 4, (wall_ms, id)) AS n, max(wall_ms) AS t0 FROM regs GROUP BY ALL),
ro AS (SELECT device_id, sub_id, arg_max(tier, (t0, tier)) AS tier, arg_max(n, (t0, tier)) AS n FROM cr WHERE tier > 0 AND n > 0 AND 2592000 - t0 <= 270000 GROUP BY ALL), wd AS (SELECT device_id, sub_id, n FROM cr WHERE tier = 0), al AS (SELECT DISTINCT device_id, sub_id FROM cr)
SELECT device_id, sub_id, CAST(CASE WHEN ro.n IS NOT NULL THEN ro.tier WHEN wd.n > 0 THEN 0 END AS INT) AS tier, CAST(CASE WHEN ro.n IS NOT NULL THEN ro.n WHEN wd.n > 0 THEN wd.n ELSE 0 END AS INT) AS carriers,
  CASE WHEN ro.n IS NOT NULL THEN ro.n > 1 WHEN wd.n > 0 THEN wd.n > 1 END AS aggregated, coalesce(ro.n IS NOT NULL AND wd.n > 0 AND wd.n <> ro.n, false) AS disagree FROM al LEFT JOIN ro USING (device_id, sub_id) LEFT JOIN wd USING (device_id, sub_id)""")
def carrier_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = domain.registrations(spark, sf_dir).select("device_id", "sub_id", "id", "wall_ms", (F.col("id") % 3).cast("int").alias("tier"), (F.col("id") % 4).cast("int").alias("n"))
    return signals.carrier_aggregation(r, ["device_id", "sub_id"], "wall_ms", 2592000)


@query(""", mp AS (SELECT ci % 11 AS phone, sub_id, count(*) AS n FROM radio GROUP BY ALL), mb AS (SELECT phone, arg_min(sub_id, (-n, sub_id)) AS v FROM mp GROUP BY phone), sl AS (SELECT DISTINCT ci % 13 AS phone, CAST(ci % 13 % 2 AS INT) AS s FROM radio)
SELECT coalesce(mb.phone, sl.phone) AS phone, coalesce(v, s) AS sub_id FROM mb FULL JOIN sl ON sl.phone = mb.phone""")
def majority_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = domain.radio(spark, sf_dir).withColumn("phone", F.col("ci") % 11)
    slots = r.select((F.col("ci") % 13).alias("phone")).distinct()  # some of them are in no pair
    return signals.majority_map(r, slots.withColumn("sub_id", (F.col("phone") % 2).cast("int")), "phone", "sub_id")


@query(""", sk AS (SELECT device_id, id, wall_ms, id % 20 AS used, CASE WHEN id % 6 <> 0 THEN CAST(25 + id * 7 % 20 AS DOUBLE) END AS cn0, wall_ms - id % 200000 AS started_ms FROM radio),
sw AS (SELECT *, count(*) OVER b AS n, avg(cn0) OVER b AS c, list_sort(list(used) OVER b) AS u FROM sk WINDOW b AS (PARTITION BY device_id ORDER BY wall_ms RANGE BETWEEN 120000 PRECEDING AND CURRENT ROW)),
sx AS (SELECT *, CAST(u[len(u) // 2 + 1] AS DOUBLE) AS m FROM sw), sy AS (SELECT *, CASE WHEN c IS NULL THEN 1 ELSE least(1, greatest(0, (40 - c) / 12)) END AS a, least(1, greatest(0, (16 - m) / 11)) AS b FROM sx), sz AS (SELECT *, n >= 5 AND NOT (wall_ms - started_ms < 30000 AND (c IS NULL OR m <= 5)) AS known, 1 - abs(a - b) AS g, least(1, n / 120.0::DOUBLE) AS f FROM sy)
SELECT id, round(CASE WHEN known THEN least(0.95::DOUBLE, greatest(0.05::DOUBLE, 0.65::DOUBLE * a + 0.35::DOUBLE * b)) END, 6) AS p_indoor, CASE WHEN NOT known THEN 'NONE' WHEN g >= 0.7::DOUBLE AND f >= 0.6::DOUBLE THEN 'HIGH' WHEN g >= 0.4::DOUBLE AND f >= 0.3::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM sz""")
def indoor_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    sky = domain.radio(spark, sf_dir).select("device_id", "id", "wall_ms", (i % 20).alias("used"), F.when(i % 6 != 0, (25 + i * 7 % 20).cast("double")).alias("cn0"), (F.col("wall_ms") - i % 200000).alias("started_ms"))
    return _round(signals.indoor_probability(sky, ["device_id"], "wall_ms", ["wall_ms", "id"], window=120000).select("id", "p_indoor", "confidence"), "p_indoor")


_HOLDS = """, hs AS (SELECT *, CASE WHEN validated THEN transport END AS s, coalesce(lead(wall_ms) OVER w, wall_ms) AS nx, lag(CASE WHEN validated THEN transport END) OVER w AS was FROM links WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
hk AS (SELECT *, sum((s IS DISTINCT FROM was OR s IS NULL)::INT) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM hs),
hg AS (SELECT device_id, s AS trigger, min(wall_ms) AS start_ms, max(nx) - min(wall_ms) AS held_ms, count(*) FILTER (not_suspended) AS sent FROM hk WHERE s IS NOT NULL GROUP BY device_id, k, s),
holds AS (SELECT device_id, trigger, start_ms, held_ms, least(held_ms, sent * 5000) AS warm_ms, least(1, CAST(least(held_ms, sent * 5000) AS DOUBLE) / held_ms) AS coverage, CAST(held_ms > 10000 AS BIGINT) AS gaps_lower, held_ms // 10000 AS gaps_upper FROM hg WHERE held_ms >= 5000)"""


def _holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = domain.links(spark, sf_dir).select("device_id", "id", "wall_ms", F.col("validated").alias("active"), F.col("transport").alias("trigger"), F.col("not_suspended").alias("sent"))
    return signals.holding_sessions(rows, ["device_id"], "wall_ms", ["wall_ms", "id"])


@query(_HOLDS + " SELECT * REPLACE (round(coverage, 6) AS coverage) FROM holds")
def holding_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_holds(spark, sf_dir), "coverage")


@query(_HOLDS + " SELECT device_id, count(*) AS sessions, CAST(sum(held_ms) AS BIGINT) AS held_ms, CAST(sum(warm_ms) AS BIGINT) AS warm_ms, CAST(sum(gaps_lower) AS BIGINT) AS gaps_lower, CAST(sum(gaps_upper) AS BIGINT) AS gaps_upper FROM holds GROUP BY device_id")
def warmth_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.warmth_summary(_holds(spark, sf_dir), ["device_id"])


_ADDRESS = "CASE WHEN id % 6 <> 0 THEN 'v4-' || (id % 8 % 3) END"


@query(f", aa AS (SELECT *, {_ADDRESS} AS address FROM links), ab AS (SELECT *, last_value(address IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM aa) SELECT device_id, id, wall_ms AS start_ms, wall_ms AS end_ms, 'ADDRESS_CHANGE' AS detector, 'OUTAGE' AS kind FROM ab WHERE address <> before")
def address_change_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = signals.address_changes(domain.links(spark, sf_dir).selectExpr("*", f"{_ADDRESS} AS address"), ["device_id"], ["wall_ms", "id"])
    return links.where("address_changed").select("device_id", "id", F.col("wall_ms").alias("start_ms"), F.col("wall_ms").alias("end_ms"), F.lit("ADDRESS_CHANGE").alias("detector"), F.lit("OUTAGE").alias("kind"))


@query(""", bl AS (SELECT DISTINCT device_id, CASE WHEN id % 5 = 4 THEN 'n' WHEN id % 29 = 0 THEN '?' ELSE 'B' END || (id % 7 * 6 + 1) AS b FROM radio) SELECT device_id, string_agg(b, ',' ORDER BY (b LIKE 'n%')::INT, try_cast(substr(b, 2) AS INT), b) AS bands FROM bl GROUP BY device_id""")
def sort_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    label = F.concat(F.when(i % 5 == 4, "n").when(i % 29 == 0, "?").otherwise("B"), (i % 7 * 6 + 1).cast("string"))
    return domain.radio(spark, sf_dir).groupBy("device_id").agg(F.array_join(signals.sort_bands(F.collect_set(label)), ",").alias("bands"))


@query("SELECT id, wall_ms FROM radio WHERE id > 100 ORDER BY wall_ms, id LIMIT 20000")
def next_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.next_batch(domain.radio(spark, sf_dir), 100).select("id", "wall_ms")


# ---- roll-ups of the other streams -------------------------------------------------------------------------------------------

_MASK = "bit_or(CAST(1 AS BIGINT) << CAST(t % 3600000 // 60000 AS BIGINT)) AS mask, min(t) AS first_ms, max(t) AS last_ms"


def _hourly_sql(name: str, table: str, keys: str, sums: str) -> str:
    return f", {name} AS (SELECT t - t % 3600000 AS hour, {keys}, count(*) AS n, {_MASK}, {sums} FROM (SELECT *, 1000 * wall_ms AS t FROM {table}) x GROUP BY ALL), {name}m AS (SELECT *, bit_count(mask) AS minutes FROM {name})"


def _timed(df: DataFrame) -> DataFrame:
    return df.withColumn("t", F.col("wall_ms") * 1000)


_count = lambda c: F.expr(c).cast("int").cast("long")


@query(_hourly_sql("hr", "regs", "sub_id", "count(*) FILTER (reg_state = 'OUT_OF_SERVICE') AS out_n, count(*) FILTER (reject_cause <> 0) AS rejected") + " SELECT * FROM hrm")
def compact_registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.compact_hour(_timed(domain.registrations(spark, sf_dir)), ["sub_id"], "t", {"out_n": _count("reg_state = 'OUT_OF_SERVICE'"), "rejected": _count("reject_cause <> 0")})


@query(", rj AS (SELECT 1000 * wall_ms - 1000 * wall_ms % 3600000 AS hour, sub_id, reject_cause, count(*) AS n FROM regs WHERE reject_cause <> 0 GROUP BY ALL) SELECT * FROM rj")
def tally_rejections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tally of reject causes beside the registration buckets, in long form."""
    return rollup.tally(_timed(domain.registrations(spark, sf_dir)).where("reject_cause <> 0"), ["sub_id"], "t", "reject_cause")


@query(_hourly_sql("hl", "links", "transport", "count(*) FILTER (validated) AS validated_n, count(*) FILTER (not_suspended) AS not_suspended_n") + " SELECT * FROM hlm")
def compact_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.compact_hour(_timed(domain.links(spark, sf_dir)), ["transport"], "t", {"validated_n": _count("validated"), "not_suspended_n": _count("not_suspended")})


@query(_COLD + _TYPED + _hourly_sql("hp", "pt1", "kind, probe_type", "count(*) FILTER (outcome = 'OK') AS ok_n, count(*) FILTER (outcome <> 'OK') AS fail_n") + " SELECT * FROM hpm")
def compact_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.compact_hour(_timed(typed_probes(spark, sf_dir)), ["kind", "probe_type"], "t", {"ok_n": _count("outcome = 'OK'"), "fail_n": _count("outcome <> 'OK'")})


@query(", ie AS (SELECT *, 'c' || (id % 3) AS chk, CASE id % 11 WHEN 0 THEN 'BROKEN' WHEN 1 THEN 'DEGRADED' ELSE 'OK' END AS level FROM regs)" + _hourly_sql("hi", "ie", "chk, level", "count(DISTINCT device_id) AS devices") + " SELECT * EXCLUDE (devices) FROM him")
def compact_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = domain.registrations(spark, sf_dir).withColumn("chk", F.concat(F.lit("c"), (i % 3).cast("string"))).withColumn("level", F.when(i % 11 == 0, "BROKEN").when(i % 11 == 1, "DEGRADED").otherwise("OK"))
    return rollup.compact_hour(_timed(rows), ["chk", "level"], "t")


@query(_COLD + _TYPED + """, lh AS (SELECT 1000 * wall_ms - 1000 * wall_ms % 3600000 AS hour, kind, CASE WHEN latency_ms < 1000 THEN latency_ms - latency_ms % 10 WHEN latency_ms < 10000 THEN latency_ms - latency_ms % 100 ELSE 10000 END AS b, outcome = 'OK' AS ok FROM pt1),
lc AS (SELECT hour, kind, b, count(*) AS w FROM lh WHERE ok GROUP BY ALL), lr AS (SELECT *, sum(w) OVER (PARTITION BY hour, kind ORDER BY b) AS run, sum(w) OVER (PARTITION BY hour, kind) AS n FROM lc),
lp AS (SELECT hour, kind, min(CASE WHEN run > floor((n - 1) * 0.5::DOUBLE + 0.5) THEN b END) AS p50_ms, min(CASE WHEN run > floor((n - 1) * 0.9::DOUBLE + 0.5) THEN b END) AS p90_ms FROM lr GROUP BY ALL), ln AS (SELECT hour, kind, count(*) AS n, count(*) FILTER (ok) AS ok_n FROM lh GROUP BY ALL)
SELECT ln.hour, ln.kind, ln.n, round(CAST(ok_n AS DOUBLE) / ln.n, 6) AS success_rate, p50_ms, p90_ms FROM ln LEFT JOIN lp USING (hour, kind)""")
def bucket_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _timed(typed_probes(spark, sf_dir)).withColumn("bin", radio.latency_bin(F.col("latency_ms"))).withColumn("ok", (F.col("outcome") == "OK"))
    buckets = rollup.compact_hour(p, ["kind"], "t", {"ok_n": F.col("ok").cast("int").cast("long")})
    hist = rollup.tally(p.where("ok"), ["kind"], "t", "bin")
    return _round(rollup.bucket_stats(buckets, hist, ["kind"], "bin").select("hour", "kind", "n", "success_rate", "p50_ms", "p90_ms"), "success_rate")


# ---- incidents ------------------------------------------------------------------------------------------------------------------


@query(_TOP + """, ix AS (SELECT top.*, w.kind, CASE WHEN top.name = 'undetermined' THEN NULL WHEN top.cause IN (1, 2, 3, 4, 12) THEN 'RADIO' WHEN top.cause IN (5, 6, 7, 11) THEN 'NETWORK' ELSE 'OTHER' END AS layer FROM top JOIN win w USING (window_id))
SELECT count(*) AS all_n, count(*) FILTER (kind = 'OUTAGE') AS outages, count(*) FILTER (kind = 'DEGRADED') AS degraded, count(*) FILTER (layer = 'RADIO') AS radio, count(*) FILTER (layer = 'NETWORK') AS network FROM ix""")
def incident_filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _features(spark, sf_dir)
    return incidents.filter_counts(incidents.assess(incidents.score_causes(f)).join(f.select("window_id", "kind"), "window_id"))


_CARDS = """CASE WHEN n_reg = 0 AND n_radio = 0 THEN 'NOT_COLLECTED' WHEN left_service THEN 'LOST' WHEN coalesce(min_rsrp, 0) <= -110 OR coalesce(min_sinr, 99) < 0 OR cell_changes >= 4 THEN 'DEGRADED' ELSE 'HEALTHY' END AS radio,
  CASE WHEN n_link = 0 THEN 'NOT_COLLECTED' WHEN validated_lost THEN 'FAILING' WHEN suspended OR route_flips > 0 THEN 'DEGRADED' ELSE 'HEALTHY' END AS network, 'NOT_COLLECTED' AS transport, CASE WHEN other_events >= 2 THEN 'DEGRADED' WHEN other_events = 0 THEN 'NOT_COLLECTED' ELSE 'NOMINAL' END AS context"""


from .incidents import _FEATURES  # noqa: E402


@query(_FEATURES + f" SELECT window_id, {_CARDS} FROM features")
def layer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.layer_cards(_features(spark, sf_dir))
