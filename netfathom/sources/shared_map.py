"""The crowd map kept up to date: what a bundle brings, replaces or retires changes only the cells that it touches.

A store (``lifecycle.Store``) holds the records of the bundles that count, dealt to buckets by their cell; an index of bundles (when
they arrived, which buckets they touch, since when they are retired); and of each bucket the published cells and statistics. A
refresh ends bundles that are replaced by a newer upload of their submission, retired, or too old, adds the new ones, and makes
anew only the buckets that either touches; all of it is one commit under the refresh's name, so a refresh that is lost is done
again and one that is repeated does nothing. Contributors are counted, so what ends takes its count back.

Uploads that are refused count for nothing. Ids are kept as hashes. An upload older than what is there, or than its id's
retirement, changes nothing, so the order of refreshes doesn't matter. Without uploads a refresh ends what is too old.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.crowd import CELL, crowd_aggregate, crowd_stats
from ..operators.lineage import cut
from .bundles import ID, MAX_AGE_DAYS, latest_submissions, records_of, validate_bundles
from .lifecycle import Store

BUCKETS = 64
INDEX = "contributor string, arrived_ms long, retired_ms long, buckets array<long>, part_day long"


def refresh(store: Store, name: str, uploads: DataFrame, format_tag: str, now_ms: int, max_age_days: int = MAX_AGE_DAYS, buckets: int = BUCKETS) -> bool:
    """Takes in ``uploads`` (path, arrived_ms, body); False if a refresh of that name was done. A store keeps its number of buckets."""
    _bucket = lambda *of: F.pmod(F.xxhash64(*of), F.lit(buckets))
    spark, now, oldest = store.spark, store.manifest(), now_ms - max_age_days * 86400000
    if name in now["deliveries"]:
        return False
    known = store.read(store.parts("index", "bundles"))
    known = known.drop("_path") if known is not None else spark.createDataFrame([], INDEX)
    good = validate_bundles(uploads, format_tag).where(F.col("reason").isNull() & (F.col("arrived_ms") >= oldest))
    gone = good.where(F.col("submission").rlike(ID) & F.col("retire").rlike(ID)).groupBy(F.sha2("retire", 256).alias("contributor")).agg(F.max("arrived_ms").alias("_retired"))
    come = latest_submissions(good).select("contributor", "doc", F.col("arrived_ms").alias("_came"))
    # one row a bundle that is known, new or retired
    line = known.drop("part_day").join(come.select("contributor", "_came"), "contributor", "full_outer").join(gone, "contributor", "full_outer")
    line = line.withColumn("retired_ms", F.greatest("retired_ms", "_retired"))
    valid = lambda t: F.coalesce(F.col(t) >= F.coalesce("retired_ms", F.col(t)), F.lit(False)) & F.coalesce(F.col(t) >= oldest, F.lit(False))
    taken = valid("_came") & F.coalesce(F.col("_came") >= F.col("arrived_ms"), F.lit(True))
    line = line.withColumns({"_taken": taken, "_ended": F.col("arrived_ms").isNotNull() & (taken | ~valid("arrived_ms"))})
    changed = line.where("_taken or _ended or _retired is not null or (arrived_ms is null and coalesce(retired_ms, 0) < %d)" % oldest)
    changed = cut(changed)
    records = records_of(come.join(changed.where("_taken").select("contributor"), "contributor", "left_semi")).withColumn("bucket", F.coalesce(F.when(F.col("area").isNotNull(), _bucket(*CELL)), F.lit(0)))
    records = brought = cut(records)
    touched = {r[0] for r in records.select("bucket").distinct().union(changed.where("_ended").select(F.explode("buckets")).distinct()).distinct().collect()}  # at most ``buckets``
    old = store.parts("raw", "records", touched)
    held = store.read(old)
    ended = changed.where("_ended").select("contributor")
    if held is not None:
        kept = held.drop("_path", "part_day").join(ended, "contributor", "left_anti")
        records = kept.unionByName(records)
    fresh = store.written(records, "raw", "records", F.col("bucket"))
    whole = store.read(fresh)
    cells, stats = [], []
    if whole is not None:
        own = whole.drop("_path")
        cells = store.written(crowd_aggregate(own).withColumn("bucket", _bucket(*CELL)), "day", "cells", F.col("bucket"))
        each = crowd_stats(own, by=["part_day"])
        stats = store.written(each, "day", "stats", F.col("part_day"))
    spots = brought.groupBy("contributor").agg(F.array_sort(F.collect_set("bucket")).alias("_in"))
    shelves = {r[0] for r in changed.select(_bucket("contributor")).distinct().collect()}  # at most ``buckets``
    shelf = store.parts("index", "bundles", shelves)
    rest = store.read(shelf)
    entries = changed.join(spots, "contributor", "left").select("contributor", F.when(F.col("_taken"), F.col("_came")).when(~F.col("_ended"), F.col("arrived_ms")).alias("arrived_ms"), F.when(F.col("retired_ms") >= oldest, F.col("retired_ms")).alias("retired_ms"), F.coalesce(F.when(F.col("_taken"), F.col("_in")).when(~F.col("_ended"), F.col("buckets")), F.array().cast("array<long>")).alias("buckets"))
    entries = entries.where("arrived_ms is not null or retired_ms is not null")
    if rest is not None:
        entries = rest.drop("_path", "part_day").join(changed.select("contributor"), "contributor", "left_anti").unionByName(entries)
    index = store.written(entries, "index", "bundles", _bucket("contributor"))
    out = {p["path"] for p in [*old, *store.parts("day", "cells", touched), *store.parts("day", "stats", touched), *shelf]}
    store.commit({**now, "parts": [p for p in now["parts"] if p["path"] not in out] + fresh + cells + stats + index, "deliveries": [*now["deliveries"], name]})
    store.sweep()
    return True


def published(store: Store) -> tuple[DataFrame | None, DataFrame | None]:
    """The cells of the map, and its one row of statistics; None before anything was taken in."""
    cells, stats = store.table("day", "cells"), store.table("day", "stats")
    drop = [] if cells is None else [c for c in ("bucket",) if c in cells.columns]
    whole = None if stats is None else stats.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("cells_seen", "cells_withheld", "cells_published", "records_dropped")])
    return (None if cells is None else cells.drop(*drop)), whole


def refresh_stream(uploads: DataFrame, store: Store, checkpoint: str, format_tag: str, clock) -> StreamingQuery:
    """Takes in the uploads of a stream as they come; ``clock`` gives the present time in milliseconds."""
    return uploads.writeStream.foreachBatch(lambda batch, n: refresh(store, f"batch {n}", batch, format_tag, clock())).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

