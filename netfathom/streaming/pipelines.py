"""Structured Streaming versions of the batch operators.

Summary tables are kept by ``foreachBatch``: a micro-batch is aggregated and merged into the touched keys, and the batch id is
stored with the rows, so that a batch that is run again replaces what it wrote. Sessions and tumbling windows use watermarks;
rows later than the watermark are dropped by Spark and can be merged by a batch run, as the accumulators only add up.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

LATENESS = "3 minutes"


def windowed_counts(stream: DataFrame, t: str, keys: list[str], width: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    """(start, keys, n) per tumbling window."""
    out = stream.withWatermark(t, lateness).groupBy(F.window(t, width), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("window.start").alias("start"), *keys, "n")


def journey_sessions(stream: DataFrame, t: str, keys: list[str], speed: str, quiet: str = "180 seconds", walking: float = 0.5, lateness: str = LATENESS) -> DataFrame:
    """(keys, start, end, n): sessions of rows above walking speed, each closed by a quiet time."""
    moving = stream.where(F.col(speed) > walking).withWatermark(t, lateness)
    out = moving.groupBy(F.session_window(t, quiet), *keys).agg(F.count("*").alias("n"), F.max(t).alias("last"))
    return out.select(*keys, F.col("session_window.start").alias("start"), F.col("last").alias("end"), "n")


def fold_into(stream: DataFrame, path: str, checkpoint: str, keys: list[str], fresh: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Keeps partial aggregates of a stream: ``fresh`` aggregates a micro-batch per key, and its rows are written to a
    partition of their batch. ``folded`` adds the partials up."""

    def write(batch: DataFrame, batch_id: int) -> None:
        fresh(batch).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def folded(spark: SparkSession, path: str, keys: list[str], merge: dict[str, Column]) -> DataFrame:
    """The table that the partials of all batches make."""
    return spark.read.parquet(path).groupBy(*keys).agg(*[c.alias(k) for k, c in merge.items()])


def stream_sites(stream: DataFrame, path: str, checkpoint: str, keys: list[str], rule: str = "v1") -> StreamingQuery:
    """Folds radio rows (keys, sinr, wall_ms) into mast hours. The stream's checkpoint is the watermark of what was folded; a new
    version of the rule starts with a table and a checkpoint of its own."""
    from ..operators.studies import site_hours

    return fold_into(stream, f"{path}/{rule}", f"{checkpoint}/{rule}", [*keys, "hour"], lambda b: site_hours(b, keys, F.floor(F.col("wall_ms") / 3600000) % 24))


def sites(spark: SparkSession, path: str, keys: list[str], rule: str = "v1") -> DataFrame:
    """The mast hours folded so far."""
    return folded(spark, f"{path}/{rule}", [*keys, "hour"], {"samples": F.sum("samples"), "below": F.sum("below"), "last_day": F.max("last_day")})


def stream_bins(stream: DataFrame, path: str, checkpoint: str, keys: list[str], place: Callable[[DataFrame], DataFrame], trigger: dict | None = None) -> StreamingQuery:
    """Folds samples into bins: ``place`` gives a micro-batch its routes, cells and weights. Each sample is folded once, in the
    batch in which it comes, however late."""
    from ..operators.bins import bin_leaves

    return fold_into(stream, path, checkpoint, keys, lambda b: bin_leaves(place(b), keys), trigger)


def refresh_shared_map(uploads: DataFrame, store: str, out: str, checkpoint: str, format_tag: str, names: DataFrame) -> StreamingQuery:
    """Keeps accepted uploads (path, arrived_ms, body) and publishes the crowd map anew whenever some arrive."""
    from ..operators.crowd import crowd_aggregate, crowd_stats
    from ..sources.bundles import latest_submissions, records_of, validate_bundles
    from ..sources.tables import publish_shared_map

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(store)
        whole = validate_bundles(spark.read.parquet(store).drop("batch"), format_tag).where("reason is null")
        records = records_of(latest_submissions(whole))
        publish_shared_map(crowd_aggregate(records), crowd_stats(records), names, out)

    return uploads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def area_state_stream(stream: DataFrame, keys: list[str], t: str, bad: str, **limits: int) -> DataFrame:
    """(keys, t, poor) where the state of an area changes. State per key: the rows of the last window and the current
    verdict; the rows of a micro-batch are taken in order of time."""
    import pandas as pd

    from ..operators.devices import DWELL_MS, ENTER, LEAST, LEAVE, WINDOW_MS

    window, least, dwell = limits.get("window", WINDOW_MS), limits.get("least", LEAST), limits.get("dwell", DWELL_MS)
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(t, kind="stable")
        times, flags, poor, since = state.get if state.exists else ([], [], False, None)
        held, n_bad, out = deque(zip(times, flags)), sum(flags), []
        for now, flag in zip(rows[t].tolist(), rows[bad].tolist()):
            held.append((now, flag))
            n_bad += flag
            while held[0][0] < now - window:
                n_bad -= held.popleft()[1]
            if len(held) >= least and (since is None or now - since >= dwell):
                share = n_bad / len(held)
                if not poor and share >= ENTER or poor and share <= LEAVE:
                    poor, since = not poor, now
                    out.append((*key, now, poor))
        state.update(([x for x, _ in held], [x for _, x in held], poor, since))
        yield pd.DataFrame(out, columns=[*keys, t, "poor"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {t} long, poor boolean"
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "times array<long>, flags array<boolean>, poor boolean, since long", "append", "NoTimeout")


def confirmed_stream(stream: DataFrame, keys: list[str], t: str, value: str, dwell: int) -> DataFrame:
    """(keys, value, since_ms, at_ms) where a value is confirmed, as ``devices.confirmed`` tells for a table. State per key: the
    present value, since when, and the last one confirmed; the rows of a micro-batch are taken in order of time."""
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(key, batches, state):
        rows = pd.concat(list(batches)).dropna(subset=[value]).sort_values(t, kind="stable")
        now, since, told = state.get if state.exists else (None, None, None)
        out = []
        for at, found in zip(rows[t].tolist(), rows[value].tolist()):
            if found != now:
                now, since = found, at
            if found != told and at - since >= dwell:
                told = found
                out.append((*key, found, since, at))
        state.update((now, since, told))
        yield pd.DataFrame(out, columns=[*keys, value, "since_ms", "at_ms"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, value]) + ", since_ms long, at_ms long"
    return stream.groupBy(*keys).applyInPandasWithState(run, schema, f"now {kinds[value]}, since long, told {kinds[value]}", "append", "NoTimeout")


def holding_stream(stream: DataFrame, keys: list[str], t: str) -> DataFrame:
    """The holds of ``signals.holding_sessions`` as they end: a hold is told when a row that is not of it comes. State per key:
    the trigger, start and sent keep-alives of the open hold; the rows of a micro-batch are taken in order of time."""
    import pandas as pd

    from ..operators.signals import measured_holds

    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def run(key, batches, state):
        rows = pd.concat(list(batches)).sort_values(t, kind="stable")
        trigger, since, sent = state.get if state.exists else (None, None, 0)
        out = []
        for at, active, found, keepalive in zip(rows[t].tolist(), rows["active"].tolist(), rows["trigger"].tolist(), rows["sent"].tolist()):
            found = (found if isinstance(found, str) else "") if active is True else None
            if found != trigger:
                if trigger is not None:
                    out.append((*key, trigger, since, at, sent))
                trigger, since, sent = found, at, 0
            sent += keepalive is True
        state.update((trigger, since, sent))
        yield pd.DataFrame(out, columns=[*keys, "trigger", "start_ms", "_end", "_sent"])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", trigger string, start_ms long, _end long, _sent long"
    return measured_holds(stream.groupBy(*keys).applyInPandasWithState(run, schema, "trigger string, since long, sent long", "append", "NoTimeout"), keys)
