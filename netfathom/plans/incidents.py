"""Queries of the incident operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..operators import incidents, intervals
from ..operators.lineage import cut
from .core import _FLOOR, _floors, _round
from .registry import query

_WINDOWS = _FLOOR + """, ox AS (SELECT *, reg_state <> 'IN_SERVICE' AS bad, lead(wall_ms) OVER w AS nx, lag(reg_state <> 'IN_SERVICE') OVER w AS was FROM regs WINDOW w AS (PARTITION BY device_id, sub_id ORDER BY wall_ms, id)),
oy AS (SELECT *, sum(CASE WHEN bad IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM ox),
oi AS (SELECT device_id, sub_id, min(wall_ms) AS start_ms, coalesce(arg_max(coalesce(nx, -1), (wall_ms, id)), -1) AS nx, max(wall_ms) AS lst FROM oy WHERE bad GROUP BY device_id, sub_id, k),
det AS (SELECT device_id, sub_id, 'DEGRADED' AS kind, start_ms, end_ms FROM floors UNION ALL SELECT device_id, sub_id, 'OUTAGE', start_ms, CASE WHEN nx < 0 THEN lst ELSE nx END FROM oi),
d1 AS (SELECT *, max(end_ms) OVER (PARTITION BY device_id, sub_id, kind ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e0 FROM det),
d2 AS (SELECT *, sum(CASE WHEN e0 IS NULL OR start_ms > e0 + 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, sub_id, kind ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM d1),
d3 AS (SELECT device_id, sub_id, kind, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM d2 GROUP BY device_id, sub_id, kind, k),
d4 AS (SELECT * FROM d3 d WHERE kind = 'OUTAGE' OR NOT EXISTS (SELECT 1 FROM d3 o WHERE o.kind = 'OUTAGE' AND o.device_id = d.device_id AND o.sub_id = d.sub_id AND d.start_ms <= o.end_ms AND o.start_ms <= d.end_ms)),
win AS (SELECT device_id || '-' || sub_id || '-' || kind || '-' || start_ms AS window_id, * FROM d4)"""

_FEATURES = _WINDOWS + """, wp AS (SELECT *, start_ms - CASE WHEN end_ms - start_ms < 10000 THEN 10000 ELSE 0 END AS lo, end_ms + CASE WHEN end_ms - start_ms < 10000 THEN 10000 ELSE 0 END AS hi FROM win),
fr0 AS (SELECT w.window_id, r.*, lag(r.ci) OVER (PARTITION BY w.window_id ORDER BY r.wall_ms, r.id) AS before FROM wp w JOIN radio r ON r.device_id = w.device_id AND r.sub_id = w.sub_id AND r.wall_ms BETWEEN w.lo AND w.hi),
fr AS (SELECT window_id, count(*) AS n_radio, min(rsrp) AS min_rsrp, max(rsrp) AS max_rsrp, min(sinr) AS min_sinr, count(ci) AS n_cells, count(DISTINCT ci) AS distinct_cells, count(*) FILTER (before <> ci) AS cell_changes FROM fr0 GROUP BY window_id),
fg AS (SELECT w.window_id, count(*) FILTER (g.sub_id = w.sub_id) AS n_reg, bool_or(g.reg_state <> 'IN_SERVICE') FILTER (g.sub_id = w.sub_id) AS left_service, bool_or(g.reject_cause <> 0) FILTER (g.sub_id = w.sub_id) AS rejected, count(*) FILTER (g.sub_id <> w.sub_id) AS other_events
  FROM wp w JOIN regs g ON g.device_id = w.device_id AND g.wall_ms BETWEEN w.lo AND w.hi GROUP BY w.window_id),
fl0 AS (SELECT w.window_id, l.wall_ms, l.id, l.transport, l.validated, l.not_suspended FROM wp w JOIN links l ON l.device_id = w.device_id AND l.wall_ms BETWEEN w.lo AND w.hi),
fl1 AS (SELECT w.window_id, l.wall_ms, l.id, l.transport, l.validated, l.not_suspended, row_number() OVER (PARTITION BY w.window_id ORDER BY l.wall_ms DESC, l.id DESC) AS rn FROM wp w JOIN links l ON l.device_id = w.device_id AND l.wall_ms <= w.lo WHERE w.window_id NOT IN (SELECT window_id FROM fl0)),
fl2 AS (SELECT * FROM fl0 UNION ALL SELECT window_id, wall_ms, id, transport, validated, not_suspended FROM fl1 WHERE rn = 1),
fl3 AS (SELECT *, lag(transport) OVER (PARTITION BY window_id ORDER BY wall_ms, id) AS before FROM fl2),
fk AS (SELECT window_id, count(*) AS n_link, bool_or(NOT validated) AS validated_lost, bool_or(NOT not_suspended) AS suspended, count(*) FILTER (before <> transport) AS route_flips, bool_or(transport = 'CELLULAR') AS on_cellular FROM fl3 GROUP BY window_id),
feat AS (SELECT w.window_id, w.device_id, w.sub_id, w.kind, w.hi - w.lo AS duration_ms, coalesce(n_radio, 0) AS n_radio, min_rsrp, max_rsrp, min_sinr, coalesce(n_cells, 0) AS n_cells, coalesce(distinct_cells, 0) AS distinct_cells, coalesce(cell_changes, 0) AS cell_changes,
  coalesce(n_reg, 0) AS n_reg, left_service, rejected, coalesce(other_events, 0) AS other_events, coalesce(n_link, 0) AS n_link, validated_lost, suspended, coalesce(route_flips, 0) AS route_flips, coalesce(on_cellular, false) AS on_cellular,
  EXISTS (SELECT 1 FROM radio r WHERE r.device_id = w.device_id AND r.sub_id = w.sub_id AND r.rat = 'NR') AS nr_seen, EXISTS (SELECT 1 FROM regs r WHERE r.device_id = w.device_id AND r.sub_id <> w.sub_id) AS other_sub
  FROM wp w LEFT JOIN fr USING (window_id) LEFT JOIN fg USING (window_id) LEFT JOIN fk USING (window_id)),
features AS (SELECT *, ((n_radio + n_reg > 0)::INT + (n_link > 0)::INT + (other_events > 0)::INT) / 4.0::DOUBLE AS coverage FROM feat)"""


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outages and degraded stretches that no outage overlaps, merged per subscription and kind."""
    keys = ["device_id", "sub_id", "kind"]
    outages = intervals.state_intervals(domain.registrations(spark, sf_dir), keys[:2], "wall_ms", F.col("reg_state") != "IN_SERVICE", ["wall_ms", "id"]).withColumn("kind", F.lit("OUTAGE"))
    found = _floors(spark, sf_dir).withColumn("kind", F.lit("DEGRADED")).select(*keys, "start_ms", "end_ms").union(outages.select(*keys, "start_ms", "end_ms"))
    merged = intervals.merge_intervals(found, keys)
    out = merged.where("kind = 'OUTAGE'")
    kept = out.union(intervals.suppress_overlaps(merged.where("kind = 'DEGRADED'"), out, keys[:2]))
    return cut(kept.select(F.concat_ws("-", "device_id", "sub_id", "kind", "start_ms").alias("window_id"), *keys, "start_ms", "end_ms"))  # five kinds of evidence read them


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.gather(windows(spark, sf_dir), domain.radio(spark, sf_dir), domain.registrations(spark, sf_dir), domain.links(spark, sf_dir), ["device_id"], "sub_id")


@query(_WINDOWS + " SELECT * FROM win")
def incident_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows(spark, sf_dir)


@query(_FEATURES + " SELECT * FROM features")
def incident_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


_ABSENT = ", ".join(f"{v} AS {k}" for k, v in incidents.ABSENT.items())
_SCORES = _FEATURES + f", fx9 AS (SELECT *, {_ABSENT} FROM features), scores AS (" + " UNION ALL ".join(f"SELECT window_id, {c} AS cause, {incidents.score_sql(c)[0]} AS confidence, {incidents.score_sql(c)[1]} AS ruled_out FROM fx9" for c in incidents.CAUSES) + ")"


@query(_SCORES + " SELECT window_id, cause, round(confidence, 6) AS confidence, ruled_out FROM scores")
def score_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(incidents.score_causes(_features(spark, sf_dir)), "confidence")


_TOP = _SCORES + """, rk AS (SELECT *, row_number() OVER w AS r, lead(cause) OVER w AS c2, lead(confidence) OVER w AS p2 FROM scores WHERE NOT ruled_out WINDOW w AS (PARTITION BY window_id ORDER BY confidence DESC, cause)),
nm(cause, cname) AS (VALUES """ + ", ".join(f"({c}, '{n}')" for c, n in incidents.CAUSES.items()) + """), top AS (SELECT window_id, rk.cause, confidence, CASE WHEN confidence >= 0.3::DOUBLE THEN cname ELSE 'undetermined' END AS name, CASE WHEN confidence - p2 <= 0.05::DOUBLE THEN c2 END AS runner_up FROM rk JOIN nm ON nm.cause = rk.cause WHERE r = 1)"""


@query(_TOP + " SELECT window_id, cause, round(confidence, 6) AS confidence, name FROM top")
def assess_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(incidents.assess(incidents.score_causes(_features(spark, sf_dir))).drop("runner_up"), "confidence")


@query(_TOP + " SELECT name, count(*) AS n, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM top), 6) AS share, CAST(row_number() OVER (ORDER BY count(*) DESC, name) AS INT) AS place FROM top GROUP BY name")
def cause_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(incidents.prevalence(incidents.assess(incidents.score_causes(_features(spark, sf_dir)))), "share")
