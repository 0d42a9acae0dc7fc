"""Queries of the scalar, time, interval and crowd operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..functions import hexgrid, radio, stats
from ..operators import crowd, intervals, timeline
from .registry import query


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# ---- hex grid -------------------------------------------------------------------------------------------------------


def hex_sql(lat: str, lng: str, res: int) -> str:
    """The cell of a point, in SQL."""
    ax, bx, ay, by = hexgrid.basis(res)
    det = ax * by - bx * ay
    x = f"({hexgrid.EARTH_M!r}::DOUBLE * radians({lng}))"
    y = f"({hexgrid.EARTH_M!r}::DOUBLE * ln(tan(pi() / 4 + radians({lat}) / 2)))"
    q, r = f"(({by!r}::DOUBLE * {x} - {bx!r}::DOUBLE * {y}) / {det!r}::DOUBLE)", f"((({ax!r}::DOUBLE * {y} - {ay!r}::DOUBLE * {x})) / {det!r}::DOUBLE)"
    s = f"(-{q} - {r})"
    near = lambda v: f"floor({v} + 0.5::DOUBLE)"
    far = lambda v: f"abs({near(v)} - {v})"
    move = f"({far(q)} > {far(s)} AND {far(q)} > {far(r)})"
    qi = f"CAST(CASE WHEN {move} THEN -{near(s)} - {near(r)} ELSE {near(q)} END AS BIGINT)"
    ri = f"CAST(CASE WHEN {move} OR {far(s)} > {far(r)} THEN {near(r)} ELSE -{near(q)} - {near(s)} END AS BIGINT)"
    return f"({hexgrid.TAG + (res << 56)} + (({qi} + 268435456) % 268435456) * 268435456 + (({ri} + 268435456) % 268435456))"


def parent_sql(cell: str, level: int) -> str:
    """The parent of a cell of resolution ``level``, in SQL."""
    part = lambda v: f"(({v} + 134217728) % 268435456 - 134217728)"
    q, r = part(f"(({cell} - {hexgrid.TAG + (level << 56)}) // 268435456)"), part(f"(({cell} - {hexgrid.TAG + (level << 56)}) % 268435456)")
    k = f"((({q} + 3 * {r}) % 7 + 7) % 7)"
    off = lambda i: "(CASE " + k + " " + " ".join(f"WHEN {j} THEN {c[i]}" for j, c in enumerate(hexgrid.CENTRE)) + " END)"
    a, b = f"((2 * ({q} - {off(0)}) - ({r} - {off(1)})) // 7)", f"((({q} - {off(0)}) + 3 * ({r} - {off(1)})) // 7)"
    return f"({hexgrid.TAG + ((level - 1) << 56)} + (({a} + 268435456) % 268435456) * 268435456 + (({b} + 268435456) % 268435456))"


def feature_sql(cell: str, res: int, properties: dict[str, bool]) -> str:
    """A bin of a resolution as a GeoJSON feature, in SQL. The properties tell whether they are numbers."""
    ax, bx, ay, by = hexgrid.basis(res)
    part = lambda v: f"(({v} + 134217728) % 268435456 - 134217728)"
    q, r = part(f"(({cell} - {hexgrid.TAG + (res << 56)}) // 268435456)"), part(f"(({cell} - {hexgrid.TAG + (res << 56)}) % 268435456)")
    x, y = f"({ax!r}::DOUBLE * {q} + {bx!r}::DOUBLE * {r})", f"({ay!r}::DOUBLE * {q} + {by!r}::DOUBLE * {r})"
    edge, turn = hexgrid.EDGE_M * 7.0 ** ((hexgrid.FINEST - res) / 2.0), (hexgrid.FINEST - res) * hexgrid.ROTATION

    def corner(k: int) -> str:
        angle = turn + math.radians(30 + 60 * k)
        lng = f"degrees(({x} + {edge * math.cos(angle)!r}::DOUBLE) / {hexgrid.EARTH_M!r}::DOUBLE)"
        lat = f"degrees(2 * atan(exp(({y} + {edge * math.sin(angle)!r}::DOUBLE) / {hexgrid.EARTH_M!r}::DOUBLE)) - {math.pi / 2!r}::DOUBLE)"
        return f"'[' || round({lng}, 6) || ',' || round({lat}, 6) || ']'"

    told = " || ".join(["'\"id\":\"' || " + cell + " || '\"'", *("coalesce(" + (f"',\"{p}\":' || {p}" if number else f"',\"{p}\":\"' || {p} || '\"'") + ", '')" for p, number in properties.items())])
    ring = " || ',' || ".join(corner(k % 6) for k in range(7))
    return f"""'{{"type":"Feature","properties":{{' || {told} || '}},"geometry":{{"type":"Polygon","coordinates":[[' || {ring} || ']]}}}}'"""


@query(f"SELECT id, {hex_sql('lat', 'lng', 10)} AS cell10, {hex_sql('lat', 'lng', 8)} AS cell8, {parent_sql(hex_sql('lat', 'lng', 10), 10)} AS parent9 FROM fixes")
def hex_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = domain.fixes(spark, sf_dir)
    cell = hexgrid.cell_of(F.col("lat"), F.col("lng"), 10)
    return f.select("id", cell.alias("cell10"), hexgrid.cell_of(F.col("lat"), F.col("lng"), 8).alias("cell8"), hexgrid.parent(cell, 9).alias("parent9"))


@query("SELECT id, CASE WHEN accuracy_m / cos(radians(lat)) <= 40 THEN 10 WHEN accuracy_m / cos(radians(lat)) <= 120 THEN 9 WHEN accuracy_m / cos(radians(lat)) <= 300 THEN 8 END AS res FROM fixes")
def hex_res_for_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.fixes(spark, sf_dir).select("id", hexgrid.res_for_accuracy(F.col("accuracy_m"), F.col("lat")).alias("res"))


# ---- scalar rules -----------------------------------------------------------------------------------------------------


@query("""SELECT id, CAST((rsrp >= -128)::INT + (rsrp >= -118)::INT + (rsrp >= -108)::INT + (rsrp >= -98)::INT AS INT) AS bars,
  CASE WHEN rat = 'LTE' THEN ci // 256 END AS enb, CASE WHEN rat = 'LTE' THEN ci % 256 END AS sector,
  CASE WHEN rat = 'LTE' THEN 'B' ELSE 'n' END || band AS band_label, '525-' || (1 + device_id % 3) AS plmn,
  rsrp < -140 OR rsrp > -43 AS rsrp_off, sinr < -20 OR sinr > 30 AS sinr_off FROM radio""")
def radio_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = domain.radio(spark, sf_dir)
    c = F.col
    return r.select("id", radio.carrier_bars(c("rsrp")).alias("bars"), radio.enb(c("rat"), c("ci")).alias("enb"), radio.sector(c("rat"), c("ci")).alias("sector"), radio.band_label(c("rat"), c("band")).alias("band_label"), radio.normalise_plmn(c("plmn")).alias("plmn"), radio.clamp_flag(c("rsrp"), "rsrp").alias("rsrp_off"), radio.clamp_flag(c("sinr"), "rssnr").alias("sinr_off"))


@query("""SELECT CASE WHEN latency_ms < 1000 THEN latency_ms - latency_ms % 10 WHEN latency_ms < 10000 THEN latency_ms - latency_ms % 100 ELSE 10000 END AS bin,
  count(*) AS n FROM probes WHERE outcome = 'OK' GROUP BY 1""")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.probes(spark, sf_dir).where("outcome = 'OK'").groupBy(radio.latency_bin(F.col("latency_ms")).alias("bin")).agg(F.count("*").alias("n"))


# ---- time ---------------------------------------------------------------------------------------------------------------

_BOOTS = """, off AS (SELECT DISTINCT device_id, wall_ms - elapsed_ms AS start FROM e),
lagged AS (SELECT *, lag(start) OVER (PARTITION BY device_id ORDER BY start) AS before FROM off),
starts AS (SELECT device_id, start, row_number() OVER (PARTITION BY device_id ORDER BY start) - 1 AS boot FROM lagged WHERE before IS NULL OR start - before > 60000),
booted AS (SELECT r.*, coalesce((SELECT max(s.boot) FROM starts s WHERE s.device_id = r.device_id AND s.start <= r.wall_ms - r.elapsed_ms), 0) AS boot FROM radio r)"""


def _booted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Radio rows with their boots, and the boots' starts."""
    starts = timeline.boot_starts([domain.events(spark, sf_dir)])
    return timeline.assign_boot(domain.radio(spark, sf_dir), starts), starts


@query(_BOOTS + " SELECT id, device_id, CAST(boot AS INT) AS boot FROM booted")
def assign_boot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _booted(spark, sf_dir)[0].select("id", "device_id", "boot")


_WEIGHTED = _BOOTS + """, weighted AS (SELECT *, CASE WHEN lead(elapsed_ms) OVER w IS NULL THEN 0 ELSE greatest(0, least(30000, lead(elapsed_ms) OVER w - elapsed_ms)) END AS weight_ms FROM booted WINDOW w AS (PARTITION BY device_id, sub_id, boot ORDER BY elapsed_ms, id))"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.time_weight(_booted(spark, sf_dir)[0], ["device_id", "sub_id", "boot"], order=["id"])


@query(_WEIGHTED + " SELECT id, CAST(weight_ms AS BIGINT) AS weight_ms FROM weighted")
def time_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("id", "weight_ms")


@query(_WEIGHTED + """ SELECT device_id, sub_id, CAST(sum(weight_ms) AS BIGINT) AS observed_ms, max(wall_ms) - min(wall_ms) AS span_ms,
  round(CASE WHEN max(wall_ms) > min(wall_ms) THEN CAST(sum(weight_ms) AS DOUBLE) / (max(wall_ms) - min(wall_ms)) END, 6) AS coverage FROM weighted GROUP BY device_id, sub_id""")
def stream_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(timeline.coverage(_weighted(spark, sf_dir), ["device_id", "sub_id"]), "coverage")


@query(""" SELECT r.id, max_by(l.transport, (l.elapsed_ms, l.id)) AS transport, max_by(l.validated, (l.elapsed_ms, l.id)) AS validated, max(l.elapsed_ms) AS route_ms
  FROM (SELECT *, (wall_ms - elapsed_ms) AS o FROM radio) r LEFT JOIN (SELECT *, (wall_ms - elapsed_ms) AS o FROM links) l
  ON l.device_id = r.device_id AND l.o = r.o AND l.elapsed_ms <= r.elapsed_ms GROUP BY r.id""")
def asof_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    starts = timeline.boot_starts([domain.events(spark, sf_dir)])
    r = timeline.assign_boot(domain.radio(spark, sf_dir), starts)
    links = timeline.assign_boot(domain.links(spark, sf_dir), starts).withColumn("route_ms", F.col("elapsed_ms"))
    # of links at one time the last id is in force
    links = links.groupBy("device_id", "boot", "elapsed_ms").agg(F.max_by(F.struct("transport", "validated", "route_ms"), "id").alias("x")).select("device_id", "boot", "elapsed_ms", "x.*")
    return timeline.asof_join(r, links, ["device_id", "boot"], "elapsed_ms", ["transport", "validated", "route_ms"]).select("id", "transport", "validated", "route_ms")


_CELL_9 = hex_sql("lat", "lng", 9) + " AS cell,"
_FIXED = ", fx AS (SELECT *, wall_ms - elapsed_ms AS o, " + _CELL_9 + """
  CASE WHEN speed_mps < 0 OR speed_mps IS NULL THEN 10000 WHEN speed_mps = 0 THEN 120000 ELSE least(120000, greatest(10000, CAST(trunc(50000 / speed_mps) AS BIGINT))) END AS w FROM fixes),
uni AS (SELECT device_id, wall_ms - elapsed_ms AS o, elapsed_ms AS t, 1 AS side, id, CAST(NULL AS BIGINT) AS cell, CAST(NULL AS DOUBLE) AS speed, CAST(NULL AS BIGINT) AS w, CAST(NULL AS BIGINT) AS ft FROM radio
  UNION ALL SELECT device_id, o, elapsed_ms, 0, id, cell, speed_mps, w, elapsed_ms FROM fx),
pn AS (SELECT *, last_value(cell IGNORE NULLS) OVER b AS pc, last_value(speed IGNORE NULLS) OVER b AS ps, last_value(w IGNORE NULLS) OVER b AS pw, last_value(ft IGNORE NULLS) OVER b AS pt,
  first_value(cell IGNORE NULLS) OVER a AS nc, first_value(speed IGNORE NULLS) OVER a AS ns, first_value(w IGNORE NULLS) OVER a AS nw, first_value(ft IGNORE NULLS) OVER a AS nt FROM uni
  WINDOW b AS (PARTITION BY device_id, o ORDER BY t, side, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY device_id, o ORDER BY t, side, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
located AS (SELECT id, t, device_id, o, CASE WHEN pc = nc AND nt - pt <= 180000 THEN pc WHEN t - pt <= pw AND (NOT coalesce(nt - t <= nw, false) OR t - pt <= nt - t) THEN pc WHEN nt - t <= nw THEN nc END AS cell,
  CASE WHEN pc = nc AND nt - pt <= 180000 THEN (ps + ns) / 2 WHEN t - pt <= pw AND (NOT coalesce(nt - t <= nw, false) OR t - pt <= nt - t) THEN ps WHEN nt - t <= nw THEN ns END AS speed FROM pn WHERE side = 1)"""


#: The same by the resolution that a fix's accuracy supports; fixes that support none are left out.
_RES = "CASE WHEN accuracy_m / cos(radians(lat)) <= 40 THEN 10 WHEN accuracy_m / cos(radians(lat)) <= 120 THEN 9 WHEN accuracy_m / cos(radians(lat)) <= 300 THEN 8 END"
_FIXED_BY_ACCURACY = _FIXED.replace(_CELL_9, f"CASE {_RES} " + " ".join(f"WHEN {r} THEN {hex_sql('lat', 'lng', r)}" for r in (10, 9, 8)) + " END AS cell,").replace("AS w FROM fixes)", f"AS w FROM fixes WHERE {_RES} IS NOT NULL)")


def _fixes_in(spark: SparkSession, sf_dir: str, starts: DataFrame, by_accuracy: bool = False) -> DataFrame:
    f = timeline.assign_boot(domain.fixes(spark, sf_dir), starts)
    if by_accuracy:
        f = f.withColumn("_res", hexgrid.res_for_accuracy(F.col("accuracy_m"), F.col("lat"))).where("_res is not null")
    return hexgrid.with_cell(f, "cell", F.col("lat"), F.col("lng"), F.col("_res") if by_accuracy else 9).withColumn("speed", F.col("speed_mps"))


def located(spark: SparkSession, sf_dir: str, df: DataFrame | None = None, starts: DataFrame | None = None, by_accuracy: bool = False) -> DataFrame:
    """Radio rows, or ``df`` with the boots of ``starts``, with the cell and speed of their place. Cells are of resolution 9, or of the
    one that the accuracy of each fix supports."""
    starts = starts if starts is not None else timeline.boot_starts([domain.events(spark, sf_dir)])
    rows = df if df is not None else timeline.assign_boot(domain.radio(spark, sf_dir), starts)
    return timeline.locate(rows, _fixes_in(spark, sf_dir, starts, by_accuracy), ["device_id", "boot"], "elapsed_ms", "cell", "speed", radio.speed_window_ms(F.col("speed")))


@query(_FIXED + " SELECT id, cell, round(speed, 6) AS speed FROM located")
def locate_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(located(spark, sf_dir).select("id", "cell", "speed"), "speed")


_COLD = """, cold AS (SELECT *, net_id <> '' AND coalesce(wall_ms - latency_ms - last_value(CASE WHEN net_id <> '' THEN wall_ms END IGNORE NULLS) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 30000, true) AS cold FROM probes)"""


@query(_COLD + " SELECT id, cold FROM cold")
def mark_cold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.mark_cold(domain.probes(spark, sf_dir), ["device_id"], on_bearer=F.col("net_id") != "").select("id", "cold")


@query(""", s AS (SELECT *, lag(reg_state) OVER w AS ps, lag(reject_cause) OVER w AS pr, row_number() OVER w AS rn FROM regs WINDOW w AS (PARTITION BY device_id, sub_id ORDER BY wall_ms, id))
  SELECT id FROM s WHERE rn = 1 OR ps IS DISTINCT FROM reg_state OR pr IS DISTINCT FROM reject_cause""")
def changes_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.changes_only(domain.registrations(spark, sf_dir), ["device_id", "sub_id"], ["reg_state", "reject_cause"], ["wall_ms", "id"]).select("id")


@query(""", f0 AS (SELECT *, id % 17 = 0 AS mock, elapsed_ms - 2000 + id * 31 % 70000 AS now_ms, CASE WHEN id % 19 <> 0 THEN elapsed_ms END AS fix_ms FROM fixes),
f1 AS (SELECT *, fix_ms IS NOT NULL AND now_ms - fix_ms BETWEEN -1000 AND 60000 AS timed, accuracy_m / greatest(cos(radians(lat)), 0.05::DOUBLE) <= 300 AS fine FROM f0),
s AS (SELECT *, max(fix_ms) FILTER (NOT mock AND timed AND fine) OVER (PARTITION BY device_id, wall_ms - elapsed_ms ORDER BY wall_ms, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM f1)
  SELECT id, CASE WHEN mock THEN 'mock' WHEN NOT timed THEN 'stale' WHEN fix_ms <= m THEN 'order' WHEN NOT fine THEN 'accuracy' END AS reject FROM s""")
def admit_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    f = timeline.assign_boot(domain.fixes(spark, sf_dir), timeline.boot_starts([domain.events(spark, sf_dir)]))
    f = f.withColumns({"mock": i % 17 == 0, "now_ms": F.col("elapsed_ms") - 2000 + i * 31 % 70000, "fix_ms": F.when(i % 19 != 0, F.col("elapsed_ms"))})
    return timeline.admit_fixes(f, ["device_id", "boot"], "fix_ms", mock="mock", now="now_ms").select("id", "reject")


# ---- weighted statistics ---------------------------------------------------------------------------------------------

_HIST = _WEIGHTED + ", h AS (SELECT device_id, sub_id, rsrp, sum(weight_ms) AS w FROM weighted GROUP BY ALL HAVING sum(weight_ms) > 0), c AS (SELECT *, sum(w) OVER (PARTITION BY device_id, sub_id ORDER BY rsrp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run, sum(w) OVER (PARTITION BY device_id, sub_id) AS n FROM h)"


def _percentile_sql(mode: str) -> str:
    rule = {"A": "run >= {q}::DOUBLE * n", "C": "run > floor((n - 1) * {q}::DOUBLE + 0.5)", "D": "run > least(n - 1, floor(n * {q}::DOUBLE))", "E": "run > floor(n / 2)"}[mode]
    return _HIST + " SELECT device_id, sub_id, " + ", ".join(f"coalesce(min(CASE WHEN {rule.format(q=q)} THEN rsrp END), max(rsrp)) AS p{int(q * 100)}" for q in (0.1, 0.5, 0.9)) + " FROM c GROUP BY device_id, sub_id"


def _percentiles(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    keys = ["device_id", "sub_id"]
    return stats.percentiles(stats.weighted_hist(_weighted(spark, sf_dir), keys, "rsrp", "weight_ms"), keys, "rsrp", mode, p10=0.1, p50=0.5, p90=0.9)


@query(_percentile_sql("A"))
def percentiles_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir, "A")


@query(_percentile_sql("C"))
def percentiles_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir, "C")


@query(_percentile_sql("D"))
def percentiles_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir, "D")


@query(_percentile_sql("E"))
def percentiles_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _percentiles(spark, sf_dir, "E")


@query(_WEIGHTED + " SELECT device_id, sub_id, rsrp, CAST(sum(weight_ms) AS BIGINT) AS weight FROM weighted GROUP BY ALL")
def weighted_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weighted_hist(_weighted(spark, sf_dir), ["device_id", "sub_id"], "rsrp", "weight_ms")


@query(_WEIGHTED + ", h AS (SELECT device_id, band, sum(weight_ms) AS w FROM weighted GROUP BY ALL) SELECT device_id, arg_min(band, (-w, band)) AS band FROM h GROUP BY device_id")
def dominant_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.dominant(stats.weighted_hist(_weighted(spark, sf_dir), ["device_id"], "band", "weight_ms"), ["device_id"], "band")


@query(_WEIGHTED + """, s AS (SELECT device_id, floor(CAST(sum(weight_ms) AS DOUBLE) * sum(weight_ms) / sum(weight_ms * weight_ms)) AS n, CAST(sum(CASE WHEN sinr >= 0 THEN weight_ms ELSE 0 END) AS DOUBLE) / sum(weight_ms) AS p FROM weighted GROUP BY device_id HAVING sum(weight_ms) > 0)
  SELECT device_id, CAST(n AS BIGINT) AS n, round(p, 6) AS p, round(greatest(0, (p + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS lo,
  round(least(1, (p + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n)), 6) AS hi FROM s""")
def good_signal_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("weight_ms")
    s = _weighted(spark, sf_dir).groupBy("device_id").agg(F.sum(w).alias("w"), F.sum(w * w).alias("w2"), F.sum(F.when(F.col("sinr") >= 0, w).otherwise(0)).alias("good")).where("w > 0")
    s = s.select("device_id", stats.effective_n(F.col("w"), F.col("w2")).cast("long").alias("n"), stats.fraction(F.col("good"), F.col("w")).alias("p"))
    ci = stats.wilson(F.col("p"), F.col("n"))
    return _round(s.select("device_id", "n", "p", ci["lo"].alias("lo"), ci["hi"].alias("hi")), "p", "lo", "hi")


# ---- intervals --------------------------------------------------------------------------------------------------------


@query(""", x AS (SELECT *, CASE WHEN wall_ms - lag(wall_ms) OVER (PARTITION BY device_id ORDER BY wall_ms, id) <= 60000 THEN 0 ELSE 1 END AS f FROM probes),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT device_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms, count(*) AS n FROM y GROUP BY device_id, k HAVING count(*) >= 2""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.gap_cluster(domain.probes(spark, sf_dir), ["device_id"], "wall_ms", 60000, ["id"], least=2)


_STATES = """, x AS (SELECT *, NOT validated AS bad, lead(wall_ms) OVER w AS nx, lag(NOT validated) OVER w AS was FROM links WINDOW w AS (PARTITION BY device_id ORDER BY wall_ms, id)),
y AS (SELECT *, sum(CASE WHEN bad IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x),
iv AS (SELECT device_id, min(wall_ms) AS start_ms, coalesce(arg_max(coalesce(nx, -1), (wall_ms, id)), -1) AS nx, max(wall_ms) AS lst FROM y WHERE bad GROUP BY device_id, k),
states AS (SELECT device_id, start_ms, CASE WHEN nx < 0 THEN lst ELSE nx END AS end_ms, nx < 0 AS ongoing FROM iv)"""


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.state_intervals(domain.links(spark, sf_dir), ["device_id"], "wall_ms", ~F.col("validated"), ["wall_ms", "id"])


@query(_STATES + " SELECT * FROM states")
def validation_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


_FLOOR = """, qx AS (SELECT *, (sinr < 0 OR rsrp <= -110) AS bad, lag(sinr < 0 OR rsrp <= -110) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id) AS was FROM radio),
qy AS (SELECT *, sum(CASE WHEN bad IS DISTINCT FROM was THEN 1 ELSE 0 END) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM qx),
floors AS (SELECT device_id, sub_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms, count(*) AS n FROM qy WHERE bad GROUP BY device_id, sub_id, k HAVING count(*) >= 3 AND max(wall_ms) - min(wall_ms) >= 15000)"""


def _floors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.sustained_runs(domain.radio(spark, sf_dir), ["device_id", "sub_id"], "wall_ms", (F.col("sinr") < 0) | (F.col("rsrp") <= -110), ["wall_ms", "id"])


@query(_FLOOR + " SELECT * FROM floors")
def quality_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _floors(spark, sf_dir)


_MERGED = _FLOOR + """, m1 AS (SELECT *, max(end_ms) OVER (PARTITION BY device_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e0 FROM floors),
m2 AS (SELECT *, sum(CASE WHEN e0 IS NULL OR start_ms > e0 + 10000 THEN 1 ELSE 0 END) OVER (PARTITION BY device_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS k FROM m1),
merged AS (SELECT device_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM m2 GROUP BY device_id, k)"""


@query(_MERGED.replace("AS n FROM m2", "AS n, bool_or(m2.n >= 5) AS observed FROM m2") + " SELECT * FROM merged")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _floors(spark, sf_dir).select("device_id", "start_ms", "end_ms", (F.col("n") >= 5).alias("observed"))
    return intervals.merge_intervals(found, ["device_id"], observed="observed")


@query(_MERGED + _STATES + " SELECT m.* FROM merged m WHERE NOT EXISTS (SELECT 1 FROM states s WHERE s.device_id = m.device_id AND m.start_ms <= s.end_ms AND s.start_ms <= m.end_ms)")
def suppress_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = intervals.merge_intervals(_floors(spark, sf_dir).select("device_id", "start_ms", "end_ms"), ["device_id"])
    return intervals.suppress_overlaps(merged, _states(spark, sf_dir), ["device_id"])


_CHANGES = """, cl AS (SELECT *, lag(ci) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id) AS before FROM radio), ch AS (SELECT * FROM cl WHERE before <> ci)"""


def _cell_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.value_changes(domain.radio(spark, sf_dir), ["device_id", "sub_id"], "ci", ["wall_ms", "id"])


@query(""", rd AS (SELECT *, CASE WHEN id % 6 <> 0 THEN ci END AS cell, CASE WHEN id % 4 = 0 THEN 'poll' ELSE 'push' END AS mode, rsrp // 48 AS level FROM radio),
r1 AS (SELECT *, lag((rat, cell, level)) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id) AS payload FROM rd), r2 AS (SELECT * FROM r1 WHERE payload IS DISTINCT FROM (rat, cell, level) AND cell IS NOT NULL),
r3 AS (SELECT *, lag(cell) OVER w AS before, lag(rat) OVER w AS rat0, lag(mode) OVER w AS mode0 FROM r2 WINDOW w AS (PARTITION BY device_id, sub_id ORDER BY wall_ms, id))
SELECT id, before, cell AS ci, CASE WHEN rat <> 'LTE' OR rat0 <> 'LTE' THEN 'undecomposable' WHEN before // 256 = cell // 256 THEN 'sector' ELSE 'mast' END AS kind, mode = 'poll' OR mode0 = 'poll' AS poll_derived,
  count(*) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms RANGE BETWEEN 120000 PRECEDING AND 120000 FOLLOWING) AS churn FROM r3 WHERE before <> cell""")
def serving_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    rows = domain.radio(spark, sf_dir).withColumns({"cell": F.when(i % 6 != 0, F.col("ci")), "mode": F.when(i % 4 == 0, "poll").otherwise("push"), "level": F.expr("rsrp div 48")}).drop("ci")
    c = intervals.serving_changes(rows.withColumnRenamed("cell", "ci"), ["device_id", "sub_id"], ["wall_ms", "id"], ["rat", "ci", "level"])
    return intervals.local_count(c, ["device_id", "sub_id"], "wall_ms", 120000, "churn").select("id", "before", "ci", "kind", "poll_derived", "churn")


@query(_CHANGES + """, x AS (SELECT *, CASE WHEN wall_ms - lag(wall_ms) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id) <= 120000 THEN 0 ELSE 1 END AS f FROM ch),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id, sub_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT device_id, sub_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms, count(*) AS n, count(DISTINCT ci) AS n_distinct FROM y GROUP BY device_id, sub_id, k HAVING count(*) >= 4 AND count(*) > count(DISTINCT ci)""")
def reselection_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.churn_clusters(_cell_changes(spark, sf_dir), ["device_id", "sub_id"], "wall_ms", "ci", order=["id"])


_FLIPS = ", fl AS (SELECT *, lag(transport) OVER (PARTITION BY device_id, wall_ms - elapsed_ms ORDER BY elapsed_ms, id) AS before FROM links), flips AS (SELECT * FROM fl WHERE before <> transport)"


@query(_FLIPS + """, x AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS total, CASE WHEN wall_ms - lag(wall_ms) OVER (PARTITION BY device_id ORDER BY wall_ms, id) <= 120000 THEN 0 ELSE 1 END AS f FROM flips),
y AS (SELECT *, sum(f) OVER (PARTITION BY device_id ORDER BY wall_ms, id ROWS UNBOUNDED PRECEDING) AS k FROM x WHERE total >= 3)
SELECT device_id, min(wall_ms) AS start_ms, max(wall_ms) AS end_ms, count(*) AS n FROM y GROUP BY device_id, k HAVING max(wall_ms) > min(wall_ms)""")
def route_flaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = timeline.assign_boot(domain.links(spark, sf_dir), timeline.boot_starts([domain.events(spark, sf_dir)]))
    flips = intervals.value_changes(links, ["device_id", "boot"], "transport", ["elapsed_ms", "id"])
    often = flips.groupBy("device_id").count().where("count >= 3").select("device_id")
    return intervals.gap_cluster(flips.join(often, "device_id", "left_semi"), ["device_id"], "wall_ms", 120000, ["id"]).where("end_ms > start_ms")


@query(_CHANGES + """ SELECT c.id, bool_or(coalesce(p.outcome = 'FAIL', false)) AS any_fail, count(p.id) AS n, sum(CASE WHEN p.outcome = 'OK' THEN p.latency_ms END) AS ok_latency
  FROM ch c LEFT JOIN probes p ON p.device_id = c.device_id AND p.wall_ms BETWEEN c.wall_ms - 36000 AND c.wall_ms + 6000 GROUP BY c.id""")
def score_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = _cell_changes(spark, sf_dir).select("device_id", F.col("id").alias("change_id"), (F.col("wall_ms") - 36000).alias("lo"), (F.col("wall_ms") + 6000).alias("hi"))
    met = intervals.bucketed_range_join(domain.probes(spark, sf_dir), changes, ["device_id"], "wall_ms", "lo", "hi", 60000)
    scored = met.groupBy("change_id").agg(F.bool_or(F.col("outcome") == "FAIL").alias("any_fail"), F.count("*").alias("n"), F.sum(F.when(F.col("outcome") == "OK", F.col("latency_ms"))).alias("ok_latency"))
    return changes.select("change_id").join(scored, "change_id", "left").select(F.col("change_id").alias("id"), F.coalesce("any_fail", F.lit(False)).alias("any_fail"), F.coalesce("n", F.lit(0)).alias("n"), "ok_latency")


# ---- crowd ------------------------------------------------------------------------------------------------------------


def crowd_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contribution records from the radio rows, some of them as hostile clients send them."""
    i, d = F.col("id"), F.col("device_id")
    r = hexgrid.with_cell(domain.radio(spark, sf_dir), "_cell", 1.25 + d % 9 * 0.004 + i % 5 * 0.0005, 103.6 + d % 7 * 0.004 + i % 3 * 0.0005, 8)
    cell = F.col("_cell").cast("string")
    n = (1 + i % 20).cast("double")
    return r.select(
        d.alias("contributor"), F.concat(cell, F.when(i % 97 == 0, "|x").otherwise("")).alias("area"), F.col("plmn").alias("network"),
        F.concat(F.lit("B"), F.col("band")).alias("band"), F.when(i % 89 == 0, -1e9).otherwise(n).alias("samples"), (n * 1000).alias("observed_ms"),
        F.create_map(F.col("rsrp").cast("double"), F.when(i % 83 == 0, 1e18).otherwise(n)).alias("rsrp"), F.create_map(F.col("sinr").cast("double"), n).alias("sinr"),
        F.concat(F.lit("2024-W"), F.lpad((i % 3 + 1).cast("string"), 2, "0")).alias("week"),
    )


_RECORDS = ", rec AS (SELECT device_id AS contributor, CAST(" + hex_sql("(CAST(1.25 AS DOUBLE) + device_id % 9 * CAST(0.004 AS DOUBLE) + id % 5 * CAST(0.0005 AS DOUBLE))", "(CAST(103.6 AS DOUBLE) + device_id % 7 * CAST(0.004 AS DOUBLE) + id % 3 * CAST(0.0005 AS DOUBLE))", 8) + """ AS VARCHAR) AS area, plmn AS network, 'B' || band AS band,
  CASE WHEN id % 89 = 0 THEN 0 ELSE 1 + id % 20 END AS samples, 1 + id % 20 AS hw, (1 + id % 20) * 1000 AS observed_ms, rsrp, sinr, '2024-W0' || (id % 3 + 1) AS week FROM radio WHERE id % 97 <> 0 AND id % 83 <> 0),
cells AS (SELECT area, network, band, count(DISTINCT contributor) AS contributors, CAST(sum(samples) AS BIGINT) AS samples, CAST(sum(observed_ms) AS BIGINT) AS observed_ms, array_to_string(list_sort(list_distinct(list(week))), ',') AS weeks FROM rec GROUP BY ALL HAVING count(DISTINCT contributor) >= 3 AND sum(samples) >= 30),
hr AS (SELECT area, network, band, rsrp AS v, sum(hw) AS w FROM rec GROUP BY ALL), hs AS (SELECT area, network, band, sinr AS v, sum(hw) AS w FROM rec GROUP BY ALL),
cr AS (SELECT *, sum(w) OVER (PARTITION BY area, network, band ORDER BY v) AS run, sum(w) OVER (PARTITION BY area, network, band) AS n FROM hr),
cs AS (SELECT *, sum(w) OVER (PARTITION BY area, network, band ORDER BY v) AS run, sum(w) OVER (PARTITION BY area, network, band) AS n FROM hs),
pr AS (SELECT area, network, band, CAST(min(CASE WHEN run >= n * 0.1::DOUBLE THEN v END) AS DOUBLE) AS rsrp_p10, CAST(min(CASE WHEN run >= n * 0.5::DOUBLE THEN v END) AS DOUBLE) AS rsrp_p50, CAST(min(CASE WHEN run >= n * 0.9::DOUBLE THEN v END) AS DOUBLE) AS rsrp_p90 FROM cr GROUP BY ALL),
ps AS (SELECT area, network, band, CAST(min(CASE WHEN run >= n * 0.1::DOUBLE THEN v END) AS DOUBLE) AS sinr_p10, CAST(min(CASE WHEN run >= n * 0.5::DOUBLE THEN v END) AS DOUBLE) AS sinr_p50, CAST(min(CASE WHEN run >= n * 0.9::DOUBLE THEN v END) AS DOUBLE) AS sinr_p90 FROM cs GROUP BY ALL)"""


@query(_RECORDS + " SELECT c.*, rsrp_p10, rsrp_p50, rsrp_p90, sinr_p10, sinr_p50, sinr_p90 FROM cells c JOIN pr USING (area, network, band) JOIN ps USING (area, network, band)")
def crowd_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.crowd_aggregate(crowd_records(spark, sf_dir)).withColumn("weeks", F.array_join("weeks", ","))


@query(_RECORDS + """, allc AS (SELECT area, network, band, count(DISTINCT contributor) >= 3 AND sum(samples) >= 30 AS ok FROM rec GROUP BY ALL)
  SELECT count(*) AS cells_seen, count(*) FILTER (NOT ok) AS cells_withheld, count(*) FILTER (ok) AS cells_published, (SELECT count(*) FROM radio WHERE id % 97 = 0 OR id % 83 = 0) AS records_dropped FROM allc""")
def crowd_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crowd.crowd_stats(crowd_records(spark, sf_dir))
