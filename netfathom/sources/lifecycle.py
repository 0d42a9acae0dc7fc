"""The life of stored rows: raw partitions, hourly and daily roll-ups, erasure; each step one commit of a manifest.

Data are written to new folders first; the next version of the manifest then names what is live, with the marks of what was
consumed; only after that are folders removed that no manifest names. A run that is lost at any step leaves either the old
manifest or the new one, and running it again does the rest: nothing is counted twice and nothing is lost. Two writers can't
commit the same version. The manifest is small: a line for each partition (kind, tier, day and delivery).

Rows have an id, a time in milliseconds and a device. A delivery is taken once, by its name; rows that come again under another
name are known by their ids, for each day up to the day's mark, the greatest id consumed. Rows of a day whose hours were
absorbed into days stay in the hourly tier. Null ids or times are not to be given; an empty delivery is a delivery.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollup import DAY_MS, retention_plan

# fixed values
RAW_DAYS, HOUR_DAYS, DAY_DAYS, BUDGET_DAYS = 30, 30, 730, 7
TIERS = ("raw", "hour", "day", "index")


@dataclass
class Rule:
    """How a kind of rows is rolled up: rows to hourly buckets (with ``hour``), buckets to days (with ``day``)."""

    hourly: Callable[[DataFrame], DataFrame]
    daily: Callable[[DataFrame], DataFrame]


class Store:
    """Tables of tiers below a folder, by the latest manifest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def manifest(self) -> dict:
        """The latest whole manifest: version, parts, marks, absorbed days, deliveries."""
        log = self._path("_log")
        versions = sorted((int(x.getPath().getName()[:12]) for x in self.fs.listStatus(log)), reverse=True) if self.fs.exists(log) else []
        for version in versions:
            if found := self._whole(version):
                return found
        return {"version": 0, "parts": [], "marks": {}, "absorbed": {}, "deliveries": []}

    def _whole(self, version: int) -> dict | None:
        """A version's manifest, or None if its writer was lost."""
        stream = self.fs.open(self._path(f"_log/{version:012}.json"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def commit(self, manifest: dict) -> None:
        """Makes ``manifest`` the next version; fails if another writer has made one from the same version."""
        version = manifest["version"] + 1
        while self.fs.exists(self._path(f"_log/{version:012}.json")) and self._whole(version) is None:
            version += 1
        out = self.fs.create(self._path(f"_log/{version:012}.json"), False)
        out.write(bytearray(json.dumps({**manifest, "version": version}).encode()))
        out.close()

    def sweep(self) -> int:
        """Removes the folders of data that the latest manifest doesn't name; how many. Not while another run is writing."""
        live = _paths(self.manifest()["parts"])
        gone = [run for tier in TIERS if self.fs.exists(self._path(tier)) for kind in self.fs.listStatus(self._path(tier)) for run in self.fs.listStatus(kind.getPath())]
        removed = 0
        for run in gone:
            at = "/".join(run.getPath().toString().split("/")[-3:])
            days = [x.getPath() for x in self.fs.listStatus(run.getPath()) if x.getPath().getName().startswith("part_day=")]
            dead = [d for d in days if f"{at}/{d.getName()}" not in live]
            for path in [run.getPath()] if len(dead) == len(days) else dead:
                self.fs.delete(path, True)
                removed += 1
        return removed

    def parts(self, tier: str, kind: str, days: set[int] | None = None) -> list[dict]:
        return [p for p in self.manifest()["parts"] if p["tier"] == tier and p["kind"] == kind and (days is None or p["day"] in days)]

    def read(self, parts: list[dict]) -> DataFrame | None:
        """The rows of some parts, with their ``part_day`` and ``_path``; None without parts."""
        if not parts:
            return None
        rows = self.spark.read.parquet(*[f"{self.folder}/{p['path']}" for p in parts])
        rows = rows.withColumn("_path", F.regexp_extract(F.col("_metadata.file_path"), f"(({'|'.join(TIERS)})/[^/]+/[^/]+/part_day=[^/]+)/[^/]+$", 1))
        return rows.withColumn("part_day", F.regexp_extract("_path", "part_day=(-?[0-9]+)$", 1).cast("long"))

    def table(self, tier: str, kind: str) -> DataFrame | None:
        rows = self.read(self.parts(tier, kind))
        return None if rows is None else rows.drop("_path", "part_day")

    def written(self, rows: DataFrame, tier: str, kind: str, day: Column, *more: Column) -> list[dict]:
        """Parts by day of rows written to a folder of their own, not yet live. ``more`` are named aggregates kept with each part."""
        name = f"{tier}/{kind}/{uuid.uuid4().hex}"
        rows.withColumn("part_day", day).hint("rebalance", "part_day").write.partitionBy("part_day").parquet(f"{self.folder}/{name}")
        found = {x.getPath().getName(): x.getPath() for x in self.fs.listStatus(self._path(name))}
        size = {n: self.fs.getContentSummary(path).getLength() for n, path in found.items() if n.startswith("part_day=")}
        if not size:
            return []
        kept = self.spark.read.parquet(f"{self.folder}/{name}").groupBy("part_day").agg(F.count("*").alias("rows"), *more).collect()
        return [{"tier": tier, "kind": kind, "day": int(r["part_day"]), "path": f"{name}/part_day={r['part_day']}", "bytes": size[f"part_day={r['part_day']}"], **{k: v for k, v in r.asDict().items() if k != "part_day"}} for r in kept]


def _day(t: str) -> Column:
    return F.floor(F.col(t) / DAY_MS)


def deliver(store: Store, delivery: str, tables: dict[str, DataFrame], t: str = "wall_ms", id_: str = "id", device: str = "device_id") -> bool:
    """Adds raw rows of some kinds as one delivery, with an index of which partition holds which device; False if a delivery of that
    name is there."""
    now = store.manifest()
    if delivery in now["deliveries"]:
        return False
    new = []
    for kind, rows in tables.items():
        parts = store.written(rows, "raw", kind, _day(t), F.min(id_).alias("first_id"), F.max(id_).alias("last_id"))
        new += parts
        whole = store.read(parts)
        if whole is not None and device in rows.columns:
            new += store.written(_index(whole, device), "index", kind, F.col("part_day"))
    store.commit({**now, "parts": now["parts"] + new, "deliveries": [*now["deliveries"], delivery]})
    return True


def _index(rows: DataFrame, device: str) -> DataFrame:
    """(device, path, part_day) of rows as read: which partition holds which device."""
    return rows.select(device, F.col("_path").alias("path"), "part_day").distinct()


def _paths(parts: list[dict]) -> set[str]:
    return {p["path"] for p in parts}


def compact(store: Store, kind: str, rule: Rule, days: set[int], id_: str = "id") -> int:
    """Rolls the raw rows of whole days up to hours and takes their partitions and index out; how many rows were new."""
    now = store.manifest()
    parts = store.parts("raw", kind, days)
    if not parts:
        return 0
    marks = {int(d): m for d, m in now["marks"].get(kind, {}).items()}
    rows = store.read(parts).drop("_path")
    ranges = sorted((p["day"], p["first_id"], p["last_id"]) for p in parts)
    if any(a[0] == b[0] and b[1] <= a[2] for a, b in zip(ranges, ranges[1:])):  # a delivery that came again
        rows = rows.dropDuplicates(["part_day", id_])
    known = [F.when(F.col("part_day") == d, F.lit(marks[d])) for d in days if d in marks]
    if known:
        rows = rows.where(F.coalesce(F.col(id_) > F.coalesce(*known), F.lit(True)))
    made = store.written(rule.hourly(rows.drop("part_day")), "hour", kind, _day("hour"))
    for p in parts:
        marks[p["day"]] = max(marks.get(p["day"], p["last_id"]), p["last_id"])
    gone = _paths(parts) | _paths(store.parts("index", kind, {p["day"] for p in parts}))
    store.commit({**now, "parts": [p for p in now["parts"] if p["path"] not in gone] + made, "marks": {**now["marks"], kind: {str(d): m for d, m in marks.items()}}})
    return sum(p["rows"] for p in made)


def absorb(store: Store, kind: str, rule: Rule, days: set[int]) -> set[int]:
    """Rolls the hours of days up to days, each day once; which ones."""
    now = store.manifest()
    fresh = {p["day"] for p in store.parts("hour", kind, days)} - set(now["absorbed"].get(kind, []))
    if fresh:
        parts = store.parts("hour", kind, fresh)
        made = store.written(rule.daily(store.read(parts).drop("_path", "part_day")), "day", kind, _day("day"))
        gone = _paths(parts)
        store.commit({**now, "parts": [p for p in now["parts"] if p["path"] not in gone] + made, "absorbed": {**now["absorbed"], kind: sorted({*now["absorbed"].get(kind, []), *fresh})}})
    return fresh


def apply_retention(store: Store, rules: dict[str, Rule], now_ms: int, budget: int, raw_days: int = RAW_DAYS, hour_days: int = HOUR_DAYS, day_days: int = DAY_DAYS, keep_days: int = BUDGET_DAYS) -> None:
    """Moves what is old on: raw days by ``retention_plan`` to hours, hours older than ``hour_days`` to days, and drops days (and
    late hours) older than ``day_days``. Each step is a commit; a run that was lost is finished by the next."""
    today = now_ms // DAY_MS
    for kind, rule in rules.items():
        sizes: dict[int, int] = {}
        for p in store.parts("raw", kind):
            sizes[p["day"]] = sizes.get(p["day"], 0) + p["bytes"]
        if sizes:
            inventory = store.spark.createDataFrame([(d * DAY_MS, b) for d, b in sizes.items()], "day long, bytes long")
            plan = retention_plan(inventory, now_ms, budget, raw_days, keep_days).where("action = 'compact'").collect()
            compact(store, kind, rule, {r["day"] // DAY_MS for r in plan})
        absorb(store, kind, rule, {p["day"] for p in store.parts("hour", kind) if today - p["day"] > hour_days})
    now = store.manifest()
    old = [p for p in now["parts"] if p["tier"] in ("hour", "day") and p["kind"] in rules and today - p["day"] > day_days]
    if old:
        store.commit({**now, "parts": [p for p in now["parts"] if p["path"] not in _paths(old)]})
    store.sweep()


def erase(store: Store, devices: DataFrame, device: str = "device_id") -> list[dict]:
    """Takes the rows of ``devices`` out of all kinds. Only partitions that hold some of them by the index are written anew; those
    and the roll-ups, which hold no device and are left, are told as (kind, tier, path, action)."""
    now, told = store.manifest(), []
    erased = devices.select(device).distinct()
    parts, new = list(now["parts"]), []
    for kind in sorted({p["kind"] for p in now["parts"]}):
        own = store.parts("index", kind)
        index = store.read(own)
        if index is not None:
            met = {r["path"] for r in index.join(erased, device, "left_semi").select("path").distinct().collect()}  # paths of a manifest
            hit = [p for p in store.parts("raw", kind) if p["path"] in met]
            if hit:
                rows = store.read(hit).drop("_path").join(erased, device, "left_anti")
                made = store.written(rows, "raw", kind, F.col("part_day"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
                days = {p["day"] for p in hit}
                rest = [p for p in own if p["day"] in days]
                left = store.read(rest).drop("_path").where(~F.col("path").isin(sorted(met)))
                whole = store.read(made)
                fresh = left if whole is None else left.unionByName(_index(whole, device))
                new += made + store.written(fresh, "index", kind, F.col("part_day"))
                gone = _paths(hit) | _paths(rest)
                parts = [p for p in parts if p["path"] not in gone]
                told += [{"kind": kind, "tier": "raw", "path": p["path"], "action": "rewritten"} for p in hit]
        told += [{"kind": kind, "tier": p["tier"], "path": p["path"], "action": "left, holds no device"} for p in now["parts"] if p["kind"] == kind and p["tier"] in ("hour", "day")]
    if new or len(parts) != len(now["parts"]):
        store.commit({**now, "parts": parts + new})
        store.sweep()
    return told
