"""The telemetry tables, mapped from the generic ``events`` table (time compressed: a millisecond per real second)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH_US = 1704067200000000
BOOT_MS = 900000


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with device_id, id, sub_id, wall_ms and elapsed_ms."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    wall = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - EPOCH_US) / 1000000).cast("long")
    e = e.select(F.col("user_id").alias("device_id"), F.col("event_id").alias("id"), (F.col("event_id") % 2).cast("int").alias("sub_id"), "event_type", "value", wall.alias("wall_ms"))
    return e.withColumn("elapsed_ms", F.col("wall_ms") % BOOT_MS)


def plmn_of(device: Column) -> Column:
    """The network of a device."""
    return F.concat(F.lit("525-"), F.lpad((1 + device % 3).cast("string"), 2, "0"))


def radio(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("id"), F.col("device_id")
    return events(spark, sf_dir).select(
        "device_id", "id", "sub_id", "wall_ms", "elapsed_ms",
        F.when(i % 5 == 4, "NR").otherwise("LTE").alias("rat"),
        plmn_of(d).alias("plmn"),
        (i % 7 % 3 + 1).cast("int").alias("band"), (256 * (d % 20) + i * 31 % 3).alias("ci"),
        (i * 7919 % 96 - 140).cast("int").alias("rsrp"), (i * 104729 % 50 - 20).cast("int").alias("sinr"),
    )


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, d = F.col("id"), F.col("device_id")
    return events(spark, sf_dir).where("event_type = 'view'").select(
        "device_id", "id", "wall_ms", "elapsed_ms",
        (1.25 + d % 9 * 0.004 + i % 5 * 0.0005).alias("lat"), (103.6 + d % 7 * 0.004 + i % 3 * 0.0005).alias("lng"),
        (10 + i % 350).cast("double").alias("accuracy_m"), (F.col("value") / 10).alias("speed_mps"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return events(spark, sf_dir).where("event_type = 'click'").select("device_id", "id", "wall_ms", "elapsed_ms", F.when(i % 3 == 0, "WIFI").otherwise("CELLULAR").alias("transport"), (i % 5 != 0).alias("validated"), (i % 11 != 0).alias("not_suspended"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return events(spark, sf_dir).where("event_type in ('purchase', 'error')").select("device_id", "id", "wall_ms", "elapsed_ms", F.when(F.col("event_type") == "error", "FAIL").otherwise("OK").alias("outcome"), F.floor(F.col("value") * 10).cast("int").alias("latency_ms"), F.when(i % 13 == 0, "").otherwise("net").alias("net_id"))


def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    return events(spark, sf_dir).where("event_type = 'signup'").select("device_id", "id", "sub_id", "wall_ms", "elapsed_ms", F.when(i % 4 == 0, "OUT_OF_SERVICE").otherwise("IN_SERVICE").alias("reg_state"), (i % 17).cast("int").alias("reject_cause"))


#: The same tables for the SQL side, as common table expressions.
SQL = f"""
ev AS (SELECT user_id AS device_id, event_id AS id, CAST(event_id % 2 AS INT) AS sub_id, event_type, value,
  CAST((epoch_us(ts) - {EPOCH_US}) // 1000000 AS BIGINT) AS wall_ms FROM events),
e AS (SELECT *, wall_ms % {BOOT_MS} AS elapsed_ms FROM ev),
radio AS (SELECT device_id, id, sub_id, wall_ms, elapsed_ms, CASE WHEN id % 5 = 4 THEN 'NR' ELSE 'LTE' END AS rat,
  '525-0' || CAST(1 + device_id % 3 AS VARCHAR) AS plmn, CAST(id % 7 % 3 + 1 AS INT) AS band,
  256 * (device_id % 20) + id * 31 % 3 AS ci, CAST(id * 7919 % 96 - 140 AS INT) AS rsrp, CAST(id * 104729 % 50 - 20 AS INT) AS sinr FROM e),
fixes AS (SELECT device_id, id, wall_ms, elapsed_ms, CAST(1.25 AS DOUBLE) + device_id % 9 * CAST(0.004 AS DOUBLE) + id % 5 * CAST(0.0005 AS DOUBLE) AS lat,
  CAST(103.6 AS DOUBLE) + device_id % 7 * CAST(0.004 AS DOUBLE) + id % 3 * CAST(0.0005 AS DOUBLE) AS lng,
  CAST(10 + id % 350 AS DOUBLE) AS accuracy_m, value / 10 AS speed_mps FROM e WHERE event_type = 'view'),
links AS (SELECT device_id, id, wall_ms, elapsed_ms, CASE WHEN id % 3 = 0 THEN 'WIFI' ELSE 'CELLULAR' END AS transport,
  id % 5 <> 0 AS validated, id % 11 <> 0 AS not_suspended FROM e WHERE event_type = 'click'),
probes AS (SELECT device_id, id, wall_ms, elapsed_ms, CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'OK' END AS outcome,
  CAST(floor(value * 10) AS INT) AS latency_ms, CASE WHEN id % 13 = 0 THEN '' ELSE 'net' END AS net_id FROM e WHERE event_type IN ('purchase', 'error')),
regs AS (SELECT device_id, id, sub_id, wall_ms, elapsed_ms, CASE WHEN id % 4 = 0 THEN 'OUT_OF_SERVICE' ELSE 'IN_SERVICE' END AS reg_state,
  CAST(id % 17 AS INT) AS reject_cause FROM e WHERE event_type = 'signup')
"""
