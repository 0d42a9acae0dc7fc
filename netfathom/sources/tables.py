"""Tables in and out: event scans, exports, shared maps, features, keyed upserts, roll-ups, erasure.

Writers of keyed or periodic tables replace only the partitions they touch (dynamic partition overwrite).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import hexgrid

MAP_FORMAT = "shared-map-1"


def read_events(spark: SparkSession, path: str, columns: list[str], since_ms: int | None = None, t: str = "wall_ms") -> DataFrame:
    """The columns of a raw table from a time on; both reach the Parquet scan."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return (df if since_ms is None else df.where(F.col(t) >= since_ms)).select(*columns)


def align_schema(parts: list[DataFrame]) -> DataFrame:
    """Tables of several schema versions as one: columns that an older one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def upsert_merge(existing: DataFrame, fresh: DataFrame, keys: list[str], merge: dict[str, Column]) -> DataFrame:
    """A keyed summary table with fresh rows merged in, by an aggregate per column."""
    return existing.unionByName(fresh).groupBy(*keys).agg(*[c.alias(k) for k, c in merge.items()])


def write_partitions(df: DataFrame, path: str, by: list[str]) -> None:
    """Replaces the partitions that ``df`` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_rollup(buckets: DataFrame, path: str, tier: str, rule: str) -> None:
    write_partitions(buckets.withColumn("tier", F.lit(tier)).withColumn("rule", F.lit(rule)), path, ["tier", "hour"])


def read_rollup(spark: SparkSession, path: str, tier: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("tier") == tier)


def read_tagged(spark: SparkSession, folder: str, kinds: dict[str, str]) -> dict[str, DataFrame]:
    """Roll-ups kept as lines of JSON, each tagged with its kind ``k``, of all files below a folder: a table per kind, whose
    schema is given. Headers, lines of other kinds, and lines that are no JSON are passed over."""
    lines = spark.read.option("recursiveFileLookup", "true").text(folder).withColumn("_k", F.get_json_object("value", "$.k"))
    return {k: lines.where(F.col("_k") == k).select(F.from_json("value", schema).alias("x")).select("x.*") for k, schema in kinds.items()}


def export_tables(tables: dict[str, DataFrame], allowed: dict[str, list[str]], out: str, t: str = "wall_ms") -> DataFrame:
    """Writes the allowed columns of each table as CSV in time order; returns the manifest (table, rows)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        own = df.select(*[c for c in allowed[name] if c in df.columns])
        (own.orderBy(t) if t in own.columns else own).write.mode("overwrite").csv(f"{out}/{name}", header=True, quote='"', escape='"')
        rows.append(own.agg(F.lit(name).alias("table"), F.count("*").alias("rows")))
    manifest = reduce(DataFrame.union, rows)
    manifest.write.mode("overwrite").json(f"{out}/manifest")
    return spark.read.json(f"{out}/manifest")


def publish_shared_map(cells: DataFrame, stats: DataFrame, names: DataFrame, out: str, format_tag: str = MAP_FORMAT) -> None:
    """Cells, a row of statistics with the format, and the names (plmn, name) of the networks that occur."""
    present = cells.select(F.col("network").alias("plmn")).distinct()
    cells.write.mode("overwrite").json(f"{out}/cells")
    stats.withColumn("format", F.lit(format_tag)).write.mode("overwrite").json(f"{out}/stats")
    names.join(present, "plmn", "left_semi").write.mode("overwrite").json(f"{out}/names")


def read_shared_map(spark: SparkSession, path: str, format_tag: str = MAP_FORMAT) -> DataFrame:
    """Published cells; the area may be a string or, from older writers, a number. A map without cells has no rows, and one of
    another format is an error."""
    told = spark.read.schema("format string").json(f"{path}/stats").first()
    if told is None or told["format"] != format_tag:
        raise ValueError(f"{path} holds no map of format {format_tag}")
    schema = "area string, network string, band string, contributors long, samples long, observed_ms long, rsrp_p10 double, rsrp_p50 double, rsrp_p90 double, sinr_p10 double, sinr_p50 double, sinr_p90 double, weeks array<string>"
    return spark.read.schema(schema).json(f"{path}/cells").withColumn("cell", F.expr("try_cast(area as bigint)")).where("cell is not null")


def to_geojson(bins: DataFrame, cell: str, properties: list[str]) -> DataFrame:
    """(feature): one GeoJSON feature per bin, its boundary and properties."""
    ring = F.transform(hexgrid.boundary(F.col(cell)), lambda p: F.array(F.round(p["lng"], 6), F.round(p["lat"], 6)))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return bins.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col(cell).cast("string").alias("id"), *properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def build_plmn_names(rows: DataFrame) -> DataFrame:
    """(plmn, name, country) from (mcc, mnc, brand, operator, status, country, ordinal): valid codes only; the brand, else the
    operator; an operational entry beats others, else the first."""
    named = rows.where(F.col("mcc").rlike("^[0-9]{3}$") & F.col("mnc").rlike("^[0-9]{2,3}$")).withColumn("name", F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.nullif(F.trim("operator"), F.lit("")))).where("name is not null")
    named = named.withColumn("plmn", F.concat_ws("-", "mcc", F.regexp_replace("mnc", "^0+(?=.)", "")))
    by = Window.partitionBy("plmn").orderBy(F.desc(F.col("status") == "Operational"), "ordinal")
    return named.withColumn("_r", F.row_number().over(by)).where("_r = 1").select("plmn", "name", "country")


def network_name(df: DataFrame, code: str, tables: list[DataFrame]) -> DataFrame:
    """Adds ``network_name``: the name in the first table (plmn, name) that has the code, else the code."""
    out, names = df, []
    for k, t in enumerate(tables):
        out = out.join(t.select(F.col("plmn").alias(f"_p{k}"), F.col("name").alias(f"_n{k}")), F.col(code) == F.col(f"_p{k}"), "left").drop(f"_p{k}")
        names.append(F.col(f"_n{k}"))
    return out.withColumn("network_name", F.coalesce(*names, F.col(code))).drop(*[f"_n{k}" for k in range(len(tables))])


def erase_devices(df: DataFrame, erased: DataFrame, device: str = "device_id") -> DataFrame:
    """The rows of no erased device."""
    return df.join(erased.select(device).distinct(), device, "left_anti")
