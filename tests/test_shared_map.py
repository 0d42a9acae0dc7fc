"""The crowd map kept by refreshes against the map of all uploads that count, whatever the order and the cut."""

import json
import random

from pyspark.sql import functions as F

from netfathom.operators.crowd import crowd_aggregate, crowd_stats
from netfathom.sources import shared_map
from netfathom.sources.bundles import latest_submissions, records_of, validate_bundles
from netfathom.sources.lifecycle import Store

TAG, DAY = "bundle-1", 86400000


def bundle(records, **more):
    return json.dumps({"format": TAG, "version": 2, "records": records, **more})


def record(area, samples=50, network="525-01", band="B3", **more):
    return {"area": area, "res": 8, "network": network, "band": band, "samples": samples, "observedMs": samples * 1000, "rsrp": {"-100": samples}, "sinr": {"5": samples}, **more}


def some_uploads(seed, now):
    rnd = random.Random(seed)
    ids = [f"{i:032x}" for i in range(12)]
    out = []
    for k in range(60):
        body = bundle([record(str(rnd.randrange(6)), rnd.choice([3, 20, 200]), week=f"2024-W{rnd.randrange(3)}") for _ in range(rnd.randrange(4))], submission=rnd.choice([*ids, None, "nonsense"]), retire=rnd.choice([None] * 6 + ids))
        out.append((f"f{k}", now - rnd.randrange(0, 40) * DAY - k, rnd.choice([body] * 9 + ["{", bundle("none"), bundle([None, "x", record(7), record("a|b"), record("8", -5)])])))
    return out


def batch_map(spark, uploads, now):
    rows = spark.createDataFrame(uploads, "path string, arrived_ms long, body string").where(F.col("arrived_ms") >= now - 30 * DAY)
    records = records_of(latest_submissions(validate_bundles(rows, TAG).where("reason is null")))
    return told(crowd_aggregate(records)), tuple(crowd_stats(records).first())


def told(cells):
    return sorted(tuple(r[c] for c in ("area", "network", "band", "contributors", "samples", "observed_ms", "rsrp_p50", "sinr_p90")) + (tuple(r["weeks"]),) for r in cells.collect())


def kept_map(store):
    cells, stats = shared_map.published(store)
    return [] if cells is None else told(cells), tuple(stats.first()) if stats is not None else (0, 0, 0, 0)


def test_refreshes_in_any_order_give_the_map_of_all(spark, tmp_path):
    now = 100 * DAY
    uploads = some_uploads(1, now)
    rnd = random.Random(2)
    rnd.shuffle(uploads)
    store = Store(spark, str(tmp_path))
    for n, (a, b) in enumerate([(0, 15), (15, 16), (16, 45), (45, 60)]):
        frame = spark.createDataFrame(uploads[a:b], "path string, arrived_ms long, body string")
        assert shared_map.refresh(store, f"r{n}", frame, TAG, now) and not shared_map.refresh(store, f"r{n}", frame, TAG, now)
    want = batch_map(spark, uploads, now)
    assert want[0] and kept_map(store) == want
    # what was taken in is too old ten days later
    assert shared_map.refresh(store, "later", spark.createDataFrame([], "path string, arrived_ms long, body string"), TAG, now + 10 * DAY)
    assert kept_map(store) == batch_map(spark, uploads, now + 10 * DAY)


def test_a_cell_goes_when_a_contributor_retires(spark, tmp_path):
    now, store = 10 * DAY, Store(spark, str(tmp_path))
    a, b, c, d = (x * 32 for x in "abcd")
    rows = [(i, 1000 + n, bundle([record("-6341066927791655000")], submission=i)) for n, i in enumerate((a, b, c))] + [("z", 1000, bundle([record("9", 900)]))]
    frame = lambda x: spark.createDataFrame(x, "path string, arrived_ms long, body string")
    shared_map.refresh(store, "one", frame(rows), TAG, now)
    assert [(r["area"], r["contributors"]) for r in shared_map.published(store)[0].collect()] == [("-6341066927791655000", 3)]
    before = {p["path"] for p in store.parts("raw", "records")}
    shared_map.refresh(store, "two", frame([("y", 5000, bundle([], submission=d, retire=a))]), TAG, now)
    cells, stats = kept_map(store)
    assert cells == [] and stats == (2, 2, 0, 0)
    # only the bucket of that cell was written anew
    assert len(before & {p["path"] for p in store.parts("raw", "records")}) == len(before) - 1
    shared_map.refresh(store, "three", frame([("late", 2000, bundle([record("-6341066927791655000")], submission=a))]), TAG, now)
    assert kept_map(store)[0] == []  # older than its retirement
    shared_map.refresh(store, "four", frame([("again", 6000, bundle([record("-6341066927791655000")], submission=a))]), TAG, now)
    assert kept_map(store)[0][0][3] == 3


def test_a_stream_of_uploads(spark, tmp_path):
    now = 50 * DAY
    uploads = some_uploads(5, now)
    for n, part in enumerate((uploads[:20], uploads[20:])):
        spark.createDataFrame(part, "path string, arrived_ms long, body string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
    stream = spark.readStream.schema("path string, arrived_ms long, body string").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    store = Store(spark, f"{tmp_path}/store")
    query = shared_map.refresh_stream(stream, store, f"{tmp_path}/cp", TAG, lambda: now)
    query.awaitTermination(200)
    assert query.exception() is None and kept_map(store) == batch_map(spark, uploads, now)
