"""The adaptive map: leaves of the resolution that each fix supports, merged with all that they hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..functions import hexgrid
from ..functions.stats import percentiles
from ..operators import bins, maps, merge
from ..operators.lineage import cut
from .core import _COLD, _FIXED, _FIXED_BY_ACCURACY, _FLIPS, parent_sql
from .coverage import _SAMPLES, _places_of, map_rows
from .maps import LABEL, with_label
from .registry import query

KEYS = ["cell", "plmn"]


def map_leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The leaves of the map by cell and network, with causes, and their sides."""
    rows, probes, flips = map_rows(spark, sf_dir, by_accuracy=True)
    rows = cut(with_label(rows))  # leaves and sides read them
    probes, flips = (x.withColumn("plmn", domain.plmn_of(F.col("device_id"))) for x in (probes, flips))
    subs = bins.bin_leaves(rows, [*KEYS, "sub_id"]).join(rows.groupBy(*KEYS, "sub_id").agg(F.min("wall_ms").alias("first_ms"), F.max("wall_ms").alias("last_ms")), [*KEYS, "sub_id"])
    leaves = merge.combined(subs, KEYS)
    leaves = leaves.join(bins.probe_bins(probes, KEYS), KEYS, "left").join(flips.groupBy(*KEYS).agg(F.count("*").alias("flaps")), KEYS, "left")
    leaves = leaves.fillna(0, ["flaps", "probe_n", "probe_fail", "no_bearer_n", "cold_n", "cold_fail"])

    text = lambda c: F.col(c).cast("string")
    serving = F.concat_ws("|", "rat", text("ci"), text("band"))
    values = [("rsrp", text("rsrp")), ("sinr", text("sinr")), ("rat", F.col("rat")), ("band", F.col("band_label")), ("serving", serving), ("member", text("device_id"))]
    own = rows.select(*KEYS, "weight_ms", F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), v.alias("value")) for m, v in values])))
    ok = probes.where("on_bearer and outcome = 'OK'").select(*KEYS, F.lit(1).cast("long").alias("weight_ms"), F.lit("latency").alias("measure"), text("latency_ms").alias("value"))
    sides = cut(own.union(ok.join(leaves.select(*KEYS), KEYS, "left_semi")).where("value is not null").groupBy(*KEYS, "measure", "value").agg(F.sum("weight_ms").alias("weight")))
    signal = sides.where("measure = 'rsrp'").select(*KEYS, F.col("value").cast("int").alias("rsrp"), "weight")
    causes = bins.measures(leaves.join(percentiles(signal, KEYS, "rsrp", "A", rsrp_p50=0.5), KEYS, "left")).withColumn("suspended", F.coalesce("suspended", F.lit(0.0)))
    return leaves.join(causes.select(*KEYS, maps.cause().alias("cause")), KEYS), sides


_SUMS = ["n", "ms", "ms_sq", "validated_ms", "suspended_ms", "cell_route_ms", "cell_route_n", "cell_validated_ms", "wifi_ms", "cell_changes", "speed_ms", "speed_mps_ms", "nr_ms", "flaps", "probe_n", "probe_fail", "no_bearer_n", "cold_n", "cold_fail", "leaf_count"]
_ALL = [*KEYS, *_SUMS, "units", "sub_id", "first_ms", "last_ms", "cause", "reason"]


def _combined_sql(source: str, keys: str, more: str = "") -> str:
    """Bins of a table with the columns of _ALL as one, in SQL."""
    sums = ", ".join(f"sum({c}) AS {c}" if c == "speed_mps_ms" else f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS)
    times = ", ".join(f"sum(CASE WHEN cause = {k} THEN ms END) AS c{k}" for k in range(1, 8))
    top = "arg_max(k, (w, -k))"
    inner = f"SELECT {keys}, {sums}, CAST(sum(units) AS BIGINT) AS units, arg_max(sub_id, (ms, n, -sub_id)) AS sub_id, min(first_ms) AS first_ms, max(last_ms) AS last_ms, {times}{', ' + more if more else ''} FROM {source} GROUP BY {keys}"
    pairs = ", ".join(f"{{'k': {k}, 'w': c{k}}}" for k in range(1, 8))
    return f"SELECT * EXCLUDE (c1, c2, c3, c4, c5, c6, c7), coalesce((SELECT {top} FROM (SELECT unnest([{pairs}], recursive := true)) q WHERE w IS NOT NULL), 0) AS cause, coalesce(CAST(greatest(c1, c2, c3, c4, c5, c6, c7) AS DOUBLE) / nullif(ms, 0), 0) AS cause_share FROM ({inner}) z"


def _classes(name: str, source: str, sides: str, keep: str = "*") -> str:
    """Table ``name``: the bins of ``source`` with ok_n, p90_ms and outcome, in SQL."""
    low = "greatest(0, ((fr + 3.8416 / (2 * probe_n)) - 1.96 * sqrt(fr * (1 - fr) / probe_n + 3.8416 / (4.0 * probe_n * probe_n))) / (1 + 3.8416 / probe_n))"
    return f""", {name}_h AS (SELECT cell, plmn, CAST(value AS BIGINT) AS v, weight AS w, sum(weight) OVER (PARTITION BY cell, plmn ORDER BY CAST(value AS BIGINT)) AS run, sum(weight) OVER (PARTITION BY cell, plmn) AS t FROM {sides} WHERE measure = 'latency'),
{name}_p AS (SELECT cell, plmn, CAST(max(t) AS BIGINT) AS ok_n, min(v) FILTER (run > floor((t - 1) * 0.9::DOUBLE + 0.5)) AS p90_ms FROM {name}_h GROUP BY ALL),
{name}_m AS (SELECT s.*, ok_n, p90_ms, greatest(ms / 60000, 1.0 / 60) AS mins, CASE WHEN speed_ms > 0 THEN speed_mps_ms / speed_ms * 3.6 ELSE 0 END AS kph, CASE WHEN cell_route_ms > 0 THEN CAST(cell_validated_ms AS DOUBLE) / cell_route_ms END AS cv, CAST(probe_fail AS DOUBLE) / nullif(probe_n, 0) AS fr FROM {source} s LEFT JOIN {name}_p p ON p.cell = s.cell AND p.plmn = s.plmn),
{name} AS (SELECT {keep}, CASE WHEN n < 8 OR cell_route_n + probe_n = 0 THEN 'UNSURVEYED' WHEN cv < 0.8 OR {low} > 0.05 THEN 'ROUTE_LOSS' WHEN greatest(0, least(1, 1 - flaps / mins / 4)) < 0.6 THEN 'ANCHOR' WHEN cell_changes / mins > 2 AND kph < 5 THEN 'RESELECT'
  WHEN cold_n > 0 AND CAST(cold_n - cold_fail AS DOUBLE) / cold_n < 0.95 OR fr > 1 - 0.95::DOUBLE OR ok_n >= 3 AND p90_ms > 1500 THEN 'SLOW' WHEN nr_ms * 2 > ms THEN 'NSA' ELSE 'LTE' END AS outcome FROM {name}_m)"""


def _walk_sql() -> str:
    samples = _SAMPLES.replace(_FIXED, _FIXED_BY_ACCURACY)
    samples = samples[: samples.index(",\nleaves AS (")]
    weighted = lambda c: f"CAST(sum(CASE WHEN {c} THEN weight_ms ELSE 0 END) AS BIGINT)"
    cellular = "transport = 'CELLULAR'"
    out = samples + _COLD + _places_of("probes", "p", _FIXED_BY_ACCURACY) + _FLIPS + _places_of("flips", "f", _FIXED_BY_ACCURACY) + f""", lb AS (SELECT *, {LABEL} AS band_label FROM samples),
su AS (SELECT cell, plmn, sub_id, count(*) AS n, CAST(sum(weight_ms) AS BIGINT) AS ms, CAST(sum(weight_ms * weight_ms) AS BIGINT) AS ms_sq, {weighted('validated')} AS validated_ms, {weighted('NOT not_suspended')} AS suspended_ms, {weighted(cellular)} AS cell_route_ms, count(*) FILTER ({cellular}) AS cell_route_n,
  {weighted(cellular + ' AND validated')} AS cell_validated_ms, {weighted("transport = 'WIFI'")} AS wifi_ms, count(*) FILTER (ci <> ci_before) AS cell_changes, {weighted('speed IS NOT NULL')} AS speed_ms, sum(coalesce(speed, 0) * weight_ms) AS speed_mps_ms, {weighted("rat = 'NR'")} AS nr_ms, min(wall_ms) AS first_ms, max(wall_ms) AS last_ms FROM lb GROUP BY ALL),
pl AS (SELECT l.cell, '525-0' || (1 + c.device_id % 3) AS plmn, c.* FROM cold c JOIN located_p l ON l.id = c.id WHERE l.cell IS NOT NULL),
pb AS (SELECT cell, plmn, count(*) FILTER (net_id <> '') AS probe_n, count(*) FILTER (net_id <> '' AND outcome = 'FAIL') AS probe_fail, count(*) FILTER (net_id = '') AS no_bearer_n, count(*) FILTER (net_id <> '' AND cold) AS cold_n, count(*) FILTER (net_id <> '' AND cold AND outcome = 'FAIL') AS cold_fail FROM pl GROUP BY ALL),
fb AS (SELECT cell, '525-0' || (1 + device_id % 3) AS plmn, count(*) AS flaps FROM located_f WHERE cell IS NOT NULL GROUP BY ALL),
l0 AS (SELECT cell, plmn, {", ".join(f"sum({c}) AS {c}" if c == "speed_mps_ms" else f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMS[:13])}, arg_max(sub_id, (ms, n, -sub_id)) AS sub_id, min(first_ms) AS first_ms, max(last_ms) AS last_ms FROM su GROUP BY cell, plmn),
l1 AS (SELECT l0.*, coalesce(flaps, 0) AS flaps, {", ".join(f"coalesce({c}, 0) AS {c}" for c in _SUMS[14:19])}, CAST(1 AS BIGINT) AS leaf_count, CAST((l0.cell - {hexgrid.TAG}) // {1 << 56} AS INT) AS res FROM l0 LEFT JOIN pb ON pb.cell = l0.cell AND pb.plmn = l0.plmn LEFT JOIN fb ON fb.cell = l0.cell AND fb.plmn = l0.plmn),
s0 AS (SELECT cell, plmn, measure, value, CAST(sum(w) AS BIGINT) AS weight FROM (SELECT cell, plmn, 'rsrp' AS measure, CAST(rsrp AS VARCHAR) AS value, weight_ms AS w FROM lb UNION ALL SELECT cell, plmn, 'sinr', CAST(sinr AS VARCHAR), weight_ms FROM lb UNION ALL SELECT cell, plmn, 'rat', rat, weight_ms FROM lb UNION ALL SELECT cell, plmn, 'band', band_label, weight_ms FROM lb
  UNION ALL SELECT cell, plmn, 'serving', rat || '|' || ci || '|' || band, weight_ms FROM lb UNION ALL SELECT cell, plmn, 'member', CAST(device_id AS VARCHAR), weight_ms FROM lb UNION ALL SELECT pl.cell, pl.plmn, 'latency', CAST(latency_ms AS VARCHAR), 1 FROM pl JOIN l0 ON l0.cell = pl.cell AND l0.plmn = pl.plmn WHERE net_id <> '' AND outcome = 'OK') x GROUP BY ALL),
r0 AS (SELECT cell, plmn, CAST(value AS INT) AS v, sum(weight) OVER (PARTITION BY cell, plmn ORDER BY CAST(value AS INT)) AS run, sum(weight) OVER (PARTITION BY cell, plmn) AS t FROM s0 WHERE measure = 'rsrp' AND weight > 0), r1 AS (SELECT cell, plmn, min(v) FILTER (run >= 0.5::DOUBLE * t) AS rsrp_p50 FROM r0 GROUP BY ALL),
l2 AS (SELECT l1.*, CAST(7 ** (10 - res) AS BIGINT) AS units, 'leaf' AS reason, CASE WHEN cell_route_n = 0 AND probe_n = 0 THEN 0 WHEN CAST(suspended_ms AS DOUBLE) / nullif(ms, 0) > 0.1::DOUBLE THEN 5 WHEN CAST(cell_validated_ms AS DOUBLE) / nullif(cell_route_ms, 0) < 0.8 THEN CASE WHEN coalesce(rsrp_p50, 0) < -115 THEN 1 ELSE 6 END WHEN probe_fail > 0 THEN 6
  WHEN cell_changes / greatest(ms / 60000, 1.0 / 60) > 2 AND CASE WHEN speed_ms > 0 THEN speed_mps_ms / speed_ms * 3.6 ELSE 0 END < 5 THEN 3 WHEN flaps > 0 AND wifi_ms * 2 > ms THEN 7 ELSE 0 END AS cause FROM l1 LEFT JOIN r1 ON r1.cell = l1.cell AND r1.plmn = l1.plmn),
a9 AS (SELECT cell, plmn, CASE WHEN res > 9 THEN {parent_sql('cell', 10)} ELSE cell END AS c9, res FROM l2), a8 AS (SELECT *, CASE WHEN res > 8 THEN {parent_sql('c9', 9)} ELSE cell END AS c8 FROM a9), a7 AS (SELECT *, CASE WHEN res > 7 THEN {parent_sql('c8', 8)} ELSE cell END AS c7 FROM a8), a6 AS (SELECT *, CASE WHEN res > 6 THEN {parent_sql('c7', 7)} ELSE cell END AS c6 FROM a7),
up AS (SELECT DISTINCT cell, plmn, unnest([c9, c8, c7, c6]) AS host FROM a6), ho AS (SELECT up.cell, up.plmn, arg_min(up.host, (up.host - {hexgrid.TAG}) // {1 << 56}) AS host FROM up JOIN l2 h ON h.cell = up.host AND h.plmn = up.plmn WHERE up.host <> up.cell GROUP BY ALL),
lh AS (SELECT l2.* REPLACE (coalesce(ho.host, l2.cell) AS cell) FROM l2 LEFT JOIN ho ON ho.cell = l2.cell AND ho.plmn = l2.plmn),
nv0 AS ({_combined_sql('lh', 'cell, plmn')}), nv AS (SELECT * REPLACE (least(units, CAST(7 ** (10 - (cell - {hexgrid.TAG}) // {1 << 56}) AS BIGINT)) AS units), CASE WHEN leaf_count > 1 THEN 'folded: coarser ground' ELSE 'leaf' END AS reason, CAST((cell - {hexgrid.TAG}) // {1 << 56} AS INT) AS res FROM nv0),
sd10 AS (SELECT coalesce(ho.host, s0.cell) AS cell, s0.plmn, measure, value, CAST(sum(weight) AS BIGINT) AS weight FROM s0 LEFT JOIN ho ON ho.cell = s0.cell AND ho.plmn = s0.plmn GROUP BY ALL),
now10 AS (SELECT * EXCLUDE (res) FROM nv WHERE res = 10)"""
    severity = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in merge.SEVERITY.items()) + " END"
    p, n_eff = "coalesce(CAST(validated_ms AS DOUBLE) / nullif(ms, 0), 0)", "(CASE WHEN ms > 0 AND ms_sq > 0 THEN floor(CAST(ms AS DOUBLE) * ms / ms_sq) ELSE 0 END)"
    bound = lambda sign: f"(({p} + 3.8416::DOUBLE / (2 * {n_eff})) {sign} 1.96::DOUBLE * sqrt({p} * (1 - {p}) / {n_eff} + 3.8416::DOUBLE / (4 * {n_eff} * {n_eff}))) / (1 + 3.8416::DOUBLE / {n_eff})"
    for r in range(10, 6, -1):
        out += f", here{r} AS (SELECT * FROM sd{r} WHERE (cell - {hexgrid.TAG}) // {1 << 56} = {r})" + _classes(f"k{r}", f"now{r}", f"here{r}", ", ".join([*_ALL, "cause_share"]))
        out += f""", q{r} AS (SELECT k.*, coalesce(m.c, 0) AS contributors, CASE WHEN {n_eff} > 0 THEN greatest(0, {bound('-')}) ELSE 0 END AS lo, CASE WHEN {n_eff} > 0 THEN least(1, {bound('+')}) ELSE 1 END AS hi, {parent_sql('k.cell', r)} AS place FROM k{r} k LEFT JOIN (SELECT cell, plmn, count(*) AS c FROM here{r} WHERE measure = 'member' GROUP BY ALL) m ON m.cell = k.cell AND m.plmn = k.plmn),
g{r} AS (SELECT * RENAME (place AS cell) FROM ({_combined_sql(f'q{r}', 'place', f"count(DISTINCT plmn) AS plmns, min(plmn) AS plmn, bool_or(contributors < 5 OR n < 30) AS thin, count(DISTINCT outcome) AS outcomes, max(lo) <= min(hi) AS overlap, max(CASE WHEN contributors >= 5 THEN {severity('outcome')} END) AS worst")}) w),
ab{r} AS (SELECT {parent_sql('cell', r)} AS cell, plmn, measure, value, CAST(sum(weight) AS BIGINT) AS weight FROM here{r} GROUP BY ALL)""" + _classes(f"w{r}", f"g{r}", f"ab{r}", "s.cell, units, plmns, thin, outcomes, overlap, worst".replace("s.cell", "cell"))
        out += f""", f{r} AS (SELECT q.* EXCLUDE (reason), CASE WHEN w.units / {float(7 ** (11 - r))}::DOUBLE < 0.35::DOUBLE THEN 'held: surveyed too little' WHEN plmns > 1 THEN 'held: several networks' WHEN thin THEN 'merged: thin' WHEN outcomes > 1 THEN 'held: outcomes differ' WHEN NOT overlap THEN 'held: intervals apart' WHEN coalesce(worst > {severity('w.outcome')}, false) THEN 'held: a worse bin' ELSE 'merged: alike' END AS reason FROM q{r} q JOIN w{r} w ON w.cell = q.place),
sd{r - 1} AS (SELECT coalesce(f.place, s.cell) AS cell, s.plmn, measure, value, CAST(sum(weight) AS BIGINT) AS weight FROM sd{r} s LEFT JOIN f{r} f ON f.cell = s.cell AND f.plmn = s.plmn AND starts_with(f.reason, 'merged') GROUP BY ALL),
m{r} AS (SELECT place AS cell, {", ".join(_ALL[1:])} FROM f{r} WHERE starts_with(reason, 'merged')),
u{r} AS (SELECT {", ".join(_ALL)} FROM ({_combined_sql(f'm{r}', 'cell, plmn', 'max(reason) AS reason')}) w UNION ALL SELECT {", ".join(_ALL)} FROM nv WHERE res = {r - 1}),
now{r - 1} AS (SELECT * REPLACE (least(units, {7 ** (11 - r)}) AS units) FROM ({_combined_sql(f'u{r}', 'cell, plmn', 'max(reason) AS reason')}) w)"""
    out += _classes("k6", "now6", "sd6", ", ".join([*_ALL, "cause_share"]))
    columns = ", ".join([*_ALL, "cause_share", "outcome"])
    out += ", pub AS (" + " UNION ALL ".join([*(f"SELECT {columns} FROM f{r} WHERE starts_with(reason, 'held')" for r in range(10, 6, -1)), f"SELECT {columns} FROM k6"]) + ")"
    median = lambda m: f"{m}0 AS (SELECT cell, plmn, CAST(value AS INT) AS v, sum(weight) OVER (PARTITION BY cell, plmn ORDER BY CAST(value AS INT)) AS run, sum(weight) OVER (PARTITION BY cell, plmn) AS t FROM sd6 WHERE measure = '{m}' AND weight > 0), {m}1 AS (SELECT cell, plmn, min(v) FILTER (run >= 0.5::DOUBLE * t) AS {m}_p50 FROM {m}0 GROUP BY ALL)"
    out += f""", {median('rsrp')}, {median('sinr')},
top AS (SELECT cell, plmn, count(*) FILTER (measure = 'member') AS contributors, count(*) FILTER (measure = 'serving') AS cells, arg_min(value, (-weight, value)) FILTER (measure = 'rat' AND weight > 0) AS rat, arg_min(value, (-weight, value)) FILTER (measure = 'band' AND weight > 0) AS band FROM sd6 GROUP BY ALL),
lt0 AS (SELECT cell, plmn, CAST(value AS BIGINT) AS v, sum(weight) OVER (PARTITION BY cell, plmn ORDER BY CAST(value AS BIGINT)) AS run, sum(weight) OVER (PARTITION BY cell, plmn) AS t FROM sd6 WHERE measure = 'latency'), lt AS (SELECT cell, plmn, CAST(max(t) AS BIGINT) AS ok_n, min(v) FILTER (run > floor((t - 1) * 0.9::DOUBLE + 0.5)) AS p90_ms FROM lt0 GROUP BY ALL)"""
    return out + """ SELECT pub.cell, pub.plmn, n, ms, flaps, probe_n, probe_fail, cold_n, units, leaf_count, sub_id, first_ms, last_ms, CAST(cause AS INT) AS cause, round(cause_share, 5) AS cause_share, outcome, reason, contributors, cells, rat, band, rsrp_p50, sinr_p50, ok_n, p90_ms
FROM pub LEFT JOIN top ON top.cell = pub.cell AND top.plmn = pub.plmn LEFT JOIN rsrp1 ON rsrp1.cell = pub.cell AND rsrp1.plmn = pub.plmn LEFT JOIN sinr1 ON sinr1.cell = pub.cell AND sinr1.plmn = pub.plmn LEFT JOIN lt ON lt.cell = pub.cell AND lt.plmn = pub.plmn"""


@query(_walk_sql())
def adaptive_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map's bins merged as far as they may be, with all they hold: sums, contributors, latencies, signal, cells and causes."""
    leaves, sides = map_leaves(spark, sf_dir)
    published, sides = merge.merge_walk(leaves, sides, merge.classifier())
    out = merge.described(published, sides)
    names = [*KEYS, "n", "ms", "flaps", "probe_n", "probe_fail", "cold_n", "units", "leaf_count", "sub_id", "first_ms", "last_ms", "cause", "cause_share", "outcome", "reason", "contributors", "cells", "rat", "band", "rsrp_p50", "sinr_p50", "ok_n", "p90_ms"]
    return out.select(*[F.round(c, 5).alias(c) if c == "cause_share" else c for c in names])
