"""Queries that keep, roll up and erase stored rows, each in a store of its own below the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import domain
from ..operators import crowd, rollup
from ..operators.lineage import cut, shared_folder
from ..sources import bundles, shared_map, tables
from ..sources.lifecycle import Rule, Store, apply_retention, compact, deliver, erase
from .registry import query

NOW_MS = 30 * rollup.DAY_MS
KEYS = ["sub_id", "plmn"]
RADIO = Rule(lambda rows: rollup.compact_hour(rows, [*KEYS, "ci"], "t"), lambda hours: rollup.roll_day(hours, KEYS, ["ci"], []))


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")


def _radio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.radio(spark, sf_dir).select("device_id", "id", *KEYS, "ci", (F.col("wall_ms") * 1000).alias("t"))


@query(", once AS (SELECT *, 1000 * wall_ms AS t FROM radio) SELECT t - t % 3600000 AS hour, sub_id, count(*) AS n FROM once GROUP BY ALL")
def compact_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows come in three deliveries, the second one twice by its name and once under another, before and after days were rolled
    up; by the marks that are stored with the hours each row is taken once."""
    store, rows = _store(spark), _radio(spark, sf_dir)
    third = lambda k: {"radio": rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == k)}
    deliver(store, "first", third(0), t="t")
    deliver(store, "second", third(1), t="t")
    deliver(store, "second", third(1), t="t")
    deliver(store, "third", third(2), t="t")
    deliver(store, "second again", third(1), t="t")
    early = {p["day"] for p in store.parts("raw", "radio") if p["day"] < 15}
    compact(store, "radio", RADIO, early)
    deliver(store, "second once more", third(1), t="t")
    compact(store, "radio", RADIO, {p["day"] for p in store.parts("raw", "radio")})
    return store.table("hour", "radio").groupBy("hour", "sub_id").agg(F.sum("n").alias("n"))


@query(""", rd AS (SELECT 1000 * wall_ms // 86400000 AS day FROM radio), tr AS (SELECT day, CASE WHEN 30 - day > 20 THEN 'day' WHEN 30 - day > 10 THEN 'hour' ELSE 'raw' END AS tier FROM rd)
SELECT tier, day, count(*) AS n FROM tr GROUP BY ALL""")
def retained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rows of radio are raw, by hour and by day after retention was applied twice, in this state and a later one."""
    store = _store(spark)
    deliver(store, "all", {"radio": _radio(spark, sf_dir)}, t="t")
    for now in (20, 30):
        apply_retention(store, {"radio": RADIO}, now * rollup.DAY_MS, 1 << 60, raw_days=10, hour_days=20)
    parts = [("raw", "t", F.count("*")), ("hour", "hour", F.sum("n")), ("day", "day", F.sum("n"))]
    tables = [(tier, t, n, store.table(tier, "radio")) for tier, t, n in parts]
    found = [rows.groupBy(F.floor(F.col(t) / rollup.DAY_MS).alias("_day")).agg(n.alias("n")).select(F.lit(tier).alias("tier"), F.col("_day").alias("day"), "n") for tier, t, n, rows in tables if rows is not None]
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


@query(""", k AS (SELECT 'radio' AS kind, device_id FROM radio UNION ALL SELECT 'fixes', device_id FROM fixes UNION ALL SELECT 'links', device_id FROM links UNION ALL SELECT 'probes', device_id FROM probes UNION ALL SELECT 'registrations', device_id FROM regs)
SELECT kind, count(*) AS n, count(DISTINCT device_id) AS devices FROM k WHERE device_id NOT IN (SELECT device_id FROM regs WHERE reg_state = 'OUT_OF_SERVICE' AND reject_cause = 3) GROUP BY kind""")
def erase_everywhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left in all tables once the devices that a certain refusal befell are erased; their partitions alone are rewritten."""
    store = _store(spark)
    tables = {"radio": domain.radio, "fixes": domain.fixes, "links": domain.links, "probes": domain.probes, "registrations": domain.registrations}
    deliver(store, "all", {kind: f(spark, sf_dir).withColumn("t", F.col("wall_ms") * 1000) for kind, f in tables.items()}, t="t")
    erase(store, domain.registrations(spark, sf_dir).where("reg_state = 'OUT_OF_SERVICE' and reject_cause = 3"))
    out = [store.table("raw", kind).select(F.lit(kind).alias("kind"), "device_id") for kind in tables]
    whole = out[0]
    for more in out[1:]:
        whole = whole.union(more)
    return whole.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("device_id").alias("devices"))


# ---- bundles, roll-ups and exports as they come from outside ------------------------------------------------------------------------

TAG = "contribution-1"
#: What each upload is like, by its id: some are no JSON, of another format, without a list of records, or with records that are no
#: objects, have numbers for areas, bars in their names or counts below zero.
_UPLOADS = """, up AS (SELECT id, device_id, 'f' || id AS path, 1000 * wall_ms AS arrived_ms, id % 11 AS k, md5('s' || device_id) AS submission, CASE WHEN id % 7 = 0 THEN md5('s' || (device_id + 1)) END AS retire,
  CAST(device_id % 6 AS VARCHAR) AS area, '525-0' || (1 + device_id % 2) AS network, 'B' || (1 + id % 2) AS band, 5 + id % 40 AS samples FROM e WHERE event_type IN ('signup', 'click')),
ok AS (SELECT * FROM up WHERE k NOT IN (0, 1, 2))"""


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, arrived_ms, body) derived from events, hostile ones among them."""
    e = domain.events(spark, sf_dir).where("event_type in ('signup', 'click')")
    i, d, text = F.col("id"), F.col("device_id"), lambda c: c.cast("string")
    k, area = i % 11, text(d % 6)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    samples = F.when(k == 6, F.lit("-1000")).otherwise(text(5 + i % 40))
    network = F.when(k == 5, F.lit("XX|YY")).otherwise(F.concat(F.lit("525-0"), text(1 + d % 2)))
    record = F.concat(F.lit('{"area":'), F.when(k == 4, area).otherwise(quoted(area)), F.lit(',"res":8,"network":'), quoted(network), F.lit(',"band":"B'), text(1 + i % 2), F.lit('","samples":'), samples, F.lit(',"observedMs":1000,"rsrp":{"-100":'), text(5 + i % 40), F.lit("}}"))
    records = F.when(k == 2, F.lit("5")).when(k == 3, F.lit('[null,"x"]')).otherwise(F.concat(F.lit("["), record, F.lit("]")))
    name = lambda device: F.md5(F.concat(F.lit("s"), text(device)).cast("binary"))
    retire = F.when(i % 7 == 0, F.concat(F.lit(',"retire":'), quoted(name(d + 1)))).otherwise("")
    body = F.concat(F.lit('{"format":"'), F.when(k == 1, F.lit("other")).otherwise(F.lit(TAG)), F.lit('","submission":'), quoted(name(d)), retire, F.lit(',"records":'), records, F.lit("}"))
    return e.select(F.concat(F.lit("f"), text(i)).alias("path"), (F.col("wall_ms") * 1000).alias("arrived_ms"), F.when(k == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))


@query(_UPLOADS + " SELECT CASE k WHEN 0 THEN 'json' WHEN 1 THEN 'format' WHEN 2 THEN 'records' END AS reason, count(*) AS n FROM up GROUP BY 1")
def bundle_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why uploads are refused; null for those that are taken."""
    return bundles.validate_bundles(_uploads(spark, sf_dir), TAG).groupBy("reason").agg(F.count("*").alias("n"))


@query(_UPLOADS + """, rc AS (SELECT k, count(*) AS n FROM ok GROUP BY k) SELECT CAST(sum(CASE WHEN k = 3 THEN 2 * n ELSE n END) AS BIGINT) AS records, CAST(sum(CASE WHEN k = 3 THEN 2 * n WHEN k IN (4, 5) THEN n ELSE 0 END) AS BIGINT) AS dropped FROM rc""")
def bundle_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records the accepted bundles hold, and how many are dropped."""
    good = bundles.validate_bundles(_uploads(spark, sf_dir), TAG).where("reason is null").withColumn("contributor", F.col("path"))
    return bundles.records_of(good).agg(F.count("*").alias("records"), F.count_if(~crowd.is_sane_record()).alias("dropped"))


@query(_UPLOADS + """, nw AS (SELECT *, row_number() OVER (PARTITION BY submission ORDER BY arrived_ms DESC, path DESC) AS r FROM ok WHERE arrived_ms >= 2592000000 - 1728000000),
rt AS (SELECT retire, max(arrived_ms) AS at FROM ok WHERE retire IS NOT NULL AND arrived_ms >= 2592000000 - 1728000000 GROUP BY retire),
kp AS (SELECT nw.* FROM nw LEFT JOIN rt ON rt.retire = nw.submission AND nw.arrived_ms < rt.at WHERE r = 1 AND rt.at IS NULL AND k NOT IN (3, 4, 5))
SELECT area, network, band, count(DISTINCT submission) AS contributors, CAST(sum(CASE WHEN k = 6 THEN 0 ELSE samples END) AS BIGINT) AS samples FROM kp GROUP BY ALL HAVING count(DISTINCT submission) >= 3 AND sum(CASE WHEN k = 6 THEN 0 ELSE samples END) >= 30""")
def refreshed_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crowd map of the uploads of the last twenty days, taken in by three refreshes out of order, the second one twice."""
    store, rows, now = _store(spark), cut(_uploads(spark, sf_dir)), NOW_MS
    part = F.pmod(F.xxhash64("path"), F.lit(3))
    for k in (1, 2, 2, 0):
        shared_map.refresh(store, f"part {k}", rows.where(part == k), TAG, now, max_age_days=20, buckets=8)
    cells, _ = shared_map.published(store)
    if cells is None:
        cells = crowd.crowd_aggregate(bundles.records_of(bundles.validate_bundles(rows.limit(0), TAG).withColumn("contributor", F.col("path"))))
    return cells.select("area", "network", "band", "contributors", "samples")


@query(""", ln AS (SELECT id, CASE WHEN id % 13 = 0 THEN 'x' WHEN id % 5 = 0 THEN 'g' ELSE 'r' END AS k, wall_ms // 3600 AS hour, sub_id, rsrp FROM radio WHERE id % 17 <> 0)
SELECT k, hour, count(*) AS lines, CAST(sum(rsrp) AS BIGINT) AS rsrp FROM ln WHERE k IN ('r', 'g') GROUP BY ALL""")
def tagged_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a roll-up file, tagged with their kind, among headers, other kinds and broken lines, by kind."""
    i = F.col("id")
    kind = F.when(i % 13 == 0, "x").when(i % 5 == 0, "g").otherwise("r")
    line = F.to_json(F.struct(kind.alias("k"), F.floor(F.col("wall_ms") / 3600).alias("hour"), "sub_id", "rsrp"))
    rows = domain.radio(spark, sf_dir).select(F.when(i % 17 == 0, F.concat(F.lit("{"), line)).otherwise(line).alias("value"))
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    rows.union(spark.createDataFrame([('{"v":3,"rule":"a"}',), ("",), ("null",)], "value string")).write.text(folder)
    found = tables.read_tagged(spark, folder, {k: "hour long, sub_id int, rsrp int" for k in ("r", "g")})
    both = found["r"].withColumn("k", F.lit("r")).union(found["g"].withColumn("k", F.lit("g")))
    return both.groupBy("k", "hour").agg(F.count("*").alias("lines"), F.sum("rsrp").alias("rsrp"))


@query(""", ev2 AS (SELECT device_id, wall_ms, rat, rsrp FROM radio WHERE wall_ms >= 1200000) SELECT 'radio' AS "table", count(*) AS rows, count(DISTINCT device_id) AS devices, CAST(sum(rsrp) AS BIGINT) AS total FROM ev2 UNION ALL SELECT 'links', count(*), count(DISTINCT device_id), NULL FROM links""")
def exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables written as Parquet in two versions of their schema, read from a time on, exported as CSV without what must not leave,
    and read again."""
    folder = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}"
    rows = domain.radio(spark, sf_dir)
    older = rows.where("wall_ms < 2000000").drop("rsrp").withColumn("note", F.lit('say "no", twice'))
    newer = rows.where("wall_ms >= 2000000")
    for n, part in enumerate((older.join(rows.select("id", "rsrp"), "id"), newer)):
        part.write.parquet(f"{folder}/raw/v={n}")
    radio = tables.read_events(spark, f"{folder}/raw", ["device_id", "wall_ms", "rat", "rsrp", "note", "ci"], 1200000)
    manifest = tables.export_tables({"radio": radio, "links": domain.links(spark, sf_dir)}, {"radio": ["device_id", "wall_ms", "rat", "rsrp", "note"], "links": ["device_id", "wall_ms", "transport"]}, f"{folder}/csv")
    back = {k: spark.read.csv(f"{folder}/csv/{k}", header=True, quote='"', escape='"') for k in ("radio", "links")}
    each = [back["radio"].where("note is null or note = 'say \"no\", twice'").agg(F.lit("radio").alias("table"), F.countDistinct("device_id").alias("devices"), F.sum(F.col("rsrp").cast("long")).alias("total")), back["links"].agg(F.lit("links"), F.countDistinct("device_id"), F.lit(None).cast("long"))]
    return manifest.join(each[0].union(each[1]), "table").select("table", "rows", "devices", "total")
