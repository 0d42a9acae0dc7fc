"""Incidents: evidence of a window, scored against a table of causes.

Each cause has weighted conditions over the evidence. A condition is true (supports), false (contradicts) or null (could not
be observed); a required one that is false rules the cause out. The conditions are data, in SQL over the feature columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .intervals import bucketed_range_join

# fixed values
CLASSIFY_FLOOR, SHORT_MS, MOST = 0.30, 10000, 0.95
CAUSES = {1: "Radio coverage loss", 2: "5G NSA anchor thrash", 3: "Cell reselection ping-pong", 4: "PS attach / PDN failure", 5: "Data suspended", 6: "Connected, path broken", 7: "Wi-Fi / cellular thrash", 8: "Device-side interference", 9: "Carrier-side congestion", 10: "DSDS tune-away", 11: "Data-subscription switch", 12: "Roaming / VoWiFi handover"}
#: The layer of each cause.
LAYERS = {1: "RADIO", 2: "RADIO", 3: "RADIO", 4: "RADIO", 5: "NETWORK", 6: "NETWORK", 7: "NETWORK", 8: "CONTEXT", 9: "TRANSPORT", 10: "CONTEXT", 11: "NETWORK", 12: "RADIO"}
#: fixed values: (cause, weight, required, condition)
RULES = [
    (1, 2, True, "CASE WHEN left_service OR min_rsrp <= -110 THEN true WHEN n_reg = 0 AND n_radio = 0 THEN NULL ELSE false END"),
    (1, 2, False, "min_rsrp <= -110"),
    (1, 1, False, "min_sinr < 0"),
    (1, 2, False, "left_service"),
    (2, 2, True, "nr_seen"),
    (2, 2, False, "CAST(NULL AS BOOLEAN)"),
    (3, 2, True, "CASE WHEN cell_changes >= 2 THEN true WHEN n_cells = 0 THEN NULL ELSE false END"),
    (3, 2, False, "n_cells > distinct_cells AND cell_changes >= 2"),
    (3, 1, False, "cell_changes >= 4"),
    (3, 1, False, "max_rsrp - min_rsrp <= 12"),
    (3, 2, False, "CAST(NULL AS BOOLEAN)"),
    (4, 2, True, "rejected"),
    (4, 1, False, "CAST(NULL AS BOOLEAN)"),
    (5, 2, True, "suspended"),
    (5, 1, False, "CAST(NULL AS BOOLEAN)"),
    (6, 2, True, "CASE WHEN validated_lost AND coalesce(left_service, false) = false THEN true WHEN validated_lost = false THEN false END"),
    (6, 2, False, "CAST(NULL AS BOOLEAN)"),
    (6, 1, False, "address_changed"),
    (6, 1, False, "v6_only AND NOT clat"),
    (7, 2, True, "CASE WHEN route_flips >= 1 THEN true WHEN n_link = 0 THEN NULL ELSE false END"),
    (7, 1, False, "route_flips >= 3"),
    (7, 1, False, "CAST(NULL AS BOOLEAN)"),
    (8, 2, True, "CASE WHEN vpn THEN true END"),
    (8, 1, False, "CAST(NULL AS BOOLEAN)"),
    (8, 1, False, "vpn"),
    (9, 2, True, "CASE WHEN cqi_seen THEN true END"),
    (9, 2, False, "CASE WHEN cqi_seen THEN min_cqi <= 6 END"),
    (9, 1, False, "CAST(NULL AS BOOLEAN)"),
    (10, 2, True, "kind = 'OUTAGE'"),
    (10, 2, True, "other_sub"),
    (10, 1, True, "route_flips = 0"),
    (10, 2, False, "n_cells > 0 AND distinct_cells = 1"),
    (10, 1, False, "max_rsrp - min_rsrp <= 3"),
    (10, 2, False, "other_events >= 2"),
    (10, 1, False, "CAST(NULL AS BOOLEAN)"),
    (11, 2, True, "CASE WHEN address_changed THEN true WHEN n_link = 0 THEN NULL ELSE false END"),
    (11, 1, True, "on_cellular"),
    (11, 1, True, "route_flips = 0"),
    (11, 2, False, "CAST(NULL AS BOOLEAN)"),
    (12, 2, True, "CASE WHEN roaming THEN true WHEN iwlan THEN false END"),
    (12, 2, False, "CAST(NULL AS BOOLEAN)"),
    (12, 1, False, "roaming"),
]
#: Features that a deployment without the column lacks, and what they are then.
ABSENT = {"address_changed": "false", "v6_only": "false", "clat": "false", "vpn": "false", "cqi_seen": "false", "min_cqi": "CAST(NULL AS INT)", "roaming": "CAST(NULL AS BOOLEAN)", "iwlan": "false"}


def gather(windows: DataFrame, radio: DataFrame, regs: DataFrame, links: DataFrame, keys: list[str], sub: str, bucket: int = 120000) -> DataFrame:
    """Evidence features per window (id, keys, sub, kind, start_ms, end_ms): rows within it, padded by 10 s if it is shorter
    than that; of links, if there are none, the last one before."""
    pad = F.when(F.col("end_ms") - F.col("start_ms") < SHORT_MS, SHORT_MS).otherwise(0)
    w = windows.withColumn("lo", F.col("start_ms") - pad).withColumn("hi", F.col("end_ms") + pad).select("window_id", *keys, F.col(sub).alias("_sub"), "kind", "lo", "hi", (F.col("hi") - F.col("lo")).alias("duration_ms"))
    inside = lambda df: bucketed_range_join(df, w, keys, "wall_ms", "lo", "hi", bucket)

    by = Window.partitionBy("window_id").orderBy("wall_ms", "id")
    r = inside(radio).where(F.col(sub) == F.col("_sub"))
    r = r.withColumn("_moved", F.col("ci") != F.lag("ci").over(by))
    r = r.groupBy("window_id").agg(F.count("*").alias("n_radio"), F.min("rsrp").alias("min_rsrp"), F.max("rsrp").alias("max_rsrp"), F.min("sinr").alias("min_sinr"), F.count("ci").alias("n_cells"), F.countDistinct("ci").alias("distinct_cells"), F.count_if("_moved").alias("cell_changes"))
    g = inside(regs)
    own = F.col(sub) == F.col("_sub")
    g = g.groupBy("window_id").agg(F.count_if(own).alias("n_reg"), F.bool_or(F.when(own, F.col("reg_state") != "IN_SERVICE")).alias("left_service"), F.bool_or(F.when(own, F.coalesce("reject_cause", F.lit(0)) != 0)).alias("rejected"), F.count_if(~own).alias("other_events"))
    found = inside(links).select("window_id", "wall_ms", "id", "transport", "validated", "not_suspended")
    before = w.join(found.select("window_id").distinct(), "window_id", "left_anti").select("window_id", *keys, F.col("lo").alias("_t"))
    marks = before.select(*keys, "_t", F.lit(1).alias("_side"), "window_id", F.lit(None).cast("struct<wall_ms:bigint,id:bigint,transport:string,validated:boolean,not_suspended:boolean>").alias("_x"))
    rows = links.select(*keys, F.col("wall_ms").alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(before.schema["window_id"].dataType).alias("window_id"), F.struct("wall_ms", "id", "transport", "validated", "not_suspended").alias("_x"))
    past = rows.union(marks.select(rows.columns)).withColumn("_x", F.last("_x", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_t", "_side", F.col("_x.id")).rowsBetween(Window.unboundedPreceding, 0)))
    l = found.union(past.where("_side = 1 and _x is not null").select("window_id", "_x.*"))  # noqa: E741
    l = l.withColumn("_flip", F.col("transport") != F.lag("transport").over(by))  # noqa: E741
    l = l.groupBy("window_id").agg(F.count("*").alias("n_link"), F.bool_or(~F.col("validated")).alias("validated_lost"), F.bool_or(~F.col("not_suspended")).alias("suspended"), F.count_if("_flip").alias("route_flips"), F.bool_or(F.col("transport") == "CELLULAR").alias("on_cellular"))  # noqa: E741
    whole = radio.groupBy(*keys, F.col(sub).alias("_sub")).agg(F.bool_or(F.col("rat") == "NR").alias("nr_seen"))
    subs = regs.groupBy(*keys).agg(F.min(sub).alias("_least"), F.max(sub).alias("_most"))
    out = w.join(r, "window_id", "left").join(g, "window_id", "left").join(l, "window_id", "left").join(whole, [*keys, "_sub"], "left").join(subs, keys, "left")
    out = out.withColumn("other_sub", F.coalesce((F.col("_least") != F.col("_sub")) | (F.col("_most") != F.col("_sub")), F.lit(False)))
    zeros = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_radio", "n_cells", "distinct_cells", "cell_changes", "n_reg", "other_events", "n_link", "route_flips")}
    flags = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("nr_seen", "on_cellular")}
    out = out.withColumns(zeros | flags).withColumn("coverage", ((F.col("n_radio") + F.col("n_reg") > 0).cast("int") + (F.col("n_link") > 0).cast("int") + (F.col("other_events") > 0).cast("int")) / 4.0)
    return out.withColumnRenamed("_sub", sub).drop("_least", "_most", "lo", "hi")


def score_sql(cause: int) -> tuple[str, str]:
    """Confidence and ruled-out of a cause, in SQL over the features."""
    own = [r for r in RULES if r[0] == cause]
    total = sum(r[1] for r in own)
    given = " + ".join(f"CASE WHEN {c} THEN {w} ELSE 0 END" for _, w, _, c in own)
    killed = " OR ".join(f"coalesce(NOT ({c}), false)" for _, _, required, c in own if required)
    short = f"CASE WHEN duration_ms >= 1 AND duration_ms < {SHORT_MS} THEN 0.8E0 ELSE 1.0E0 END"
    return f"CASE WHEN {killed} THEN 0.0E0 ELSE least({MOST}E0, ({given}) / {total}.0E0 * (0.55E0 + 0.45E0 * coverage) * {short}) END", f"({killed})"


def score_causes(features: DataFrame) -> DataFrame:
    """(window_id, cause, confidence, ruled_out) for each of the causes."""
    have = features.withColumns({k: F.expr(v) for k, v in ABSENT.items() if k not in features.columns})
    scored = [F.struct(F.lit(c).alias("cause"), F.expr(score_sql(c)[0]).alias("confidence"), F.expr(score_sql(c)[1]).alias("ruled_out")) for c in CAUSES]
    return have.select("window_id", F.inline(F.array(*scored)))


def assess(scores: DataFrame) -> DataFrame:
    """(window_id, cause, confidence, name, runner_up): the best cause not ruled out; 'undetermined' below the floor;
    ``runner_up``: the next cause if it is at most 0.05 behind."""
    by = Window.partitionBy("window_id").orderBy(F.desc("confidence"), "cause")
    ranked = scores.where("not ruled_out").withColumn("_r", F.row_number().over(by)).withColumn("_c", F.lead("cause").over(by)).withColumn("_p", F.lead("confidence").over(by)).where("_r = 1")
    names = F.create_map(*[F.lit(x) for kv in CAUSES.items() for x in kv])
    sure = F.col("confidence") >= CLASSIFY_FLOOR
    return ranked.select("window_id", "cause", "confidence", F.when(sure, names[F.col("cause")]).otherwise("undetermined").alias("name"), F.when(F.col("confidence") - F.col("_p") <= 0.05, F.col("_c")).alias("runner_up"))


def prevalence(assessed: DataFrame) -> DataFrame:
    """(name, n, share, place) of causes over all incidents."""
    n = assessed.groupBy("name").agg(F.count("*").alias("n"))
    total = assessed.agg(F.count("*").alias("_t"))
    out = n.crossJoin(F.broadcast(total))  # one row joined on
    return out.select("name", "n", (F.col("n") / F.col("_t")).alias("share"), F.row_number().over(Window.orderBy(F.desc("n"), "name")).alias("place"))  # a row per cause


def filter_counts(assessed: DataFrame) -> DataFrame:
    """One row: how many assessed incidents (cause, name, kind) each filter of the list shows."""
    layer = F.when(F.col("name") != "undetermined", F.create_map(*[F.lit(x) for kv in LAYERS.items() for x in kv])[F.col("cause")])
    of = lambda c, name: F.count_if(c).alias(name)
    return assessed.agg(F.count("*").alias("all_n"), of(F.col("kind") == "OUTAGE", "outages"), of(F.col("kind") == "DEGRADED", "degraded"), of(layer == "RADIO", "radio"), of(layer == "NETWORK", "network"))


def layer_cards(features: DataFrame) -> DataFrame:
    """(window_id, radio, network, transport, context): the verdict on each layer; a layer without rows was not collected."""
    c, none = F.col, F.lit("NOT_COLLECTED")
    weak = (F.coalesce("min_rsrp", F.lit(0)) <= -110) | (F.coalesce("min_sinr", F.lit(99)) < 0) | (c("cell_changes") >= 4)
    radio = F.when((c("n_reg") == 0) & (c("n_radio") == 0), none).when(c("left_service"), "LOST").when(weak, "DEGRADED").otherwise("HEALTHY")
    changed = c("address_changed") if "address_changed" in features.columns else F.lit(False)
    network = F.when(c("n_link") == 0, none).when(c("validated_lost") | changed, "FAILING").when(c("suspended") | (c("route_flips") > 0), "DEGRADED").otherwise("HEALTHY")
    context = F.when(c("other_events") >= 2, "DEGRADED").when(c("other_events") == 0, none).otherwise("NOMINAL")
    return features.select("window_id", radio.alias("radio"), network.alias("network"), none.alias("transport"), context.alias("context"))
