"""Contribution bundles: reading a folder, checking uploads, and one bundle per submission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_BYTES, MAX_AGE_DAYS = 512 * 1024, 30  # fixed values
ID = "^[a-f0-9]{32}$"
RECORD = "struct<area:string,network:string,band:string,samples:double,observedMs:double,rsrp:map<string,double>,sinr:map<string,double>,week:string>"


def read_bundles(spark: SparkSession, folder: str, now_ms: int, max_age_days: int = MAX_AGE_DAYS) -> DataFrame:
    """(path, arrived_ms, body) of the files below a folder that are not older than ``max_age_days``."""
    files = spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.unix_millis("_metadata.file_modification_time").alias("arrived_ms"), F.col("value").alias("body"))
    return files.where(F.col("arrived_ms") >= now_ms - max_age_days * 86400000)


def validate_bundles(uploads: DataFrame, format_tag: str) -> DataFrame:
    """Adds ``doc`` (a variant) and ``reason`` (null if accepted): size, json, format, records."""
    doc = uploads.withColumn("doc", F.try_parse_json("body"))
    text = lambda p: F.expr(f"try_variant_get(doc, '$.{p}', 'string')")
    kind = F.expr("schema_of_variant(try_variant_get(doc, '$.records', 'variant'))")
    reason = F.when(F.octet_length("body") > MAX_BYTES, "size").when(F.col("doc").isNull(), "json").when(~F.coalesce(text("format") == format_tag, F.lit(False)), "format").when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), "records")
    return doc.withColumn("reason", reason).withColumn("submission", text("submission")).withColumn("retire", text("retire"))


def latest_submissions(uploads: DataFrame) -> DataFrame:
    """One upload per valid submission id, the newest; an upload's ``retire`` removes the earlier uploads of that id. Uploads
    without a valid id count each as a contributor of its own. Adds ``contributor``; the ids are taken off."""
    valid = F.col("submission").rlike(ID)
    named = uploads.where(F.coalesce(valid, F.lit(False)))
    newest = named.withColumn("_r", F.row_number().over(Window.partitionBy("submission").orderBy(F.desc("arrived_ms"), F.desc("path")))).where("_r = 1").drop("_r")
    retired = named.where(F.col("retire").rlike(ID)).groupBy(F.col("retire").alias("_retired")).agg(F.max("arrived_ms").alias("_at"))
    kept = newest.join(retired, (F.col("submission") == F.col("_retired")) & (F.col("arrived_ms") < F.col("_at")), "left_anti")
    rest = uploads.where(~F.coalesce(valid, F.lit(False)))
    return kept.withColumn("contributor", F.sha2("submission", 256)).unionByName(rest.withColumn("contributor", F.sha2("path", 256))).drop("submission", "retire")


def records_of(bundles: DataFrame) -> DataFrame:
    """The records of accepted bundles (contributor, doc). A record that is no object, and one whose area is a number (which
    cannot hold the id), comes with a null area and so is dropped by the record check."""
    each = bundles.select("contributor", F.explode(F.expr("try_variant_get(doc, '$.records', 'array<variant>')")).alias("r"))
    text = F.expr("case when schema_of_variant(try_variant_get(r, '$.area', 'variant')) = 'STRING' then try_variant_get(r, '$.area', 'string') end")
    number = lambda p: F.expr(f"try_variant_get(r, '$.{p}', 'double')")
    string = lambda p: F.expr(f"case when schema_of_variant(try_variant_get(r, '$.{p}', 'variant')) = 'STRING' then try_variant_get(r, '$.{p}', 'string') end")
    hist = lambda p: F.expr(f"transform_keys(try_variant_get(r, '$.{p}', 'map<string,double>'), (k, v) -> coalesce(try_cast(k as double), double('NaN')))")
    return each.select("contributor", text.alias("area"), string("network").alias("network"), string("band").alias("band"), number("samples").alias("samples"), number("observedMs").alias("observed_ms"), hist("rsrp").alias("rsrp"), hist("sinr").alias("sinr"), string("week").alias("week"))
