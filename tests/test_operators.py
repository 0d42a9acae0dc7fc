"""Hand-made rows on both sides of each constant, golden scenarios, and brute-force checks of the ordered rules."""

import json
import random

import pytest
from pyspark.sql import functions as F

from netfathom.functions import hexgrid, radio, stats
from netfathom.operators import bins, crowd, devices, intervals, rollup, studies, timeline
from netfathom.sources import bundles, tables
from netfathom.streaming import pipelines


def record(area, samples, contributor, **more):
    base = {"contributor": contributor, "area": area, "network": "525-10", "band": "B40", "samples": float(samples), "observed_ms": 1000.0, "rsrp": {-100.0: float(min(samples, 60))}, "sinr": None, "week": "2024-W01"}
    return base | more


SCHEMA = "contributor string, area string, network string, band string, samples double, observed_ms double, rsrp map<double,double>, sinr map<double,double>, week string"


def frame(spark, rows):
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def test_crowd_needs_contributors_and_samples(spark):
    rows = [record("111", 500, "a")]
    rows += [record("222", 900, c) for c in "ab"] + [record("333", 200, c) for c in "abc"] + [record("444", 5, c) for c in "abc"]
    rows += [record("555", 400, "a", week=f"2024-W0{k}") for k in (1, 2, 3)]
    cells = crowd.crowd_aggregate(frame(spark, rows)).collect()
    assert [(c["area"], c["contributors"], c["samples"]) for c in cells] == [("333", 3, 600)]
    assert tuple(crowd.crowd_stats(frame(spark, rows)).first()) == (5, 4, 1, 0)


def test_crowd_withstands_hostile_records(spark):
    honest = [record("333", 50, c) for c in "abc"]
    hostile = [record("333", -1e9, "x", rsrp=None), record("333", 5, "y", rsrp={-140.0: 1e18}), record("333", 50, "z", network="XX|YY"), record(None, 50, "n"), record("333", 6e6, "m")]
    (cell,) = crowd.crowd_aggregate(frame(spark, honest + hostile)).collect()
    assert cell["rsrp_p50"] == -100 and cell["samples"] == 150
    assert crowd.crowd_aggregate(frame(spark, [])).count() == 0


def test_bundles_are_checked_and_areas_keep_their_digits(spark):
    good = json.dumps({"format": "tag", "records": [{"area": "-6341066927791655000", "network": "525-10", "band": "B40", "samples": 50, "observedMs": 9, "rsrp": {"-100": 50}}, None, "x", {"area": 333}]})
    bodies = [good, "{", json.dumps({"format": "other", "records": []}), json.dumps({"format": "tag", "records": 1}), "[" + "1," * 300000 + "1]"]
    ups = spark.createDataFrame([(str(i), i, b) for i, b in enumerate(bodies)], "path string, arrived_ms long, body string")
    checked = bundles.validate_bundles(ups, "tag")
    assert [r["reason"] for r in checked.orderBy("arrived_ms").collect()] == [None, "json", "format", "records", "size"]
    records = bundles.records_of(bundles.latest_submissions(checked.where("reason is null")))
    assert sorted((r["area"] or "") for r in records.collect()) == ["", "", "", "-6341066927791655000"]
    assert records.where(crowd.is_sane_record()).count() == 1


def test_latest_submission_wins_and_retires(spark):
    a, b = "a" * 32, "b" * 32
    rows = [("1", 1, a, None), ("2", 2, a, None), ("3", 3, b, a), ("4", 4, None, None), ("5", 5, "bad", None)]
    up = spark.createDataFrame(rows, "path string, arrived_ms long, submission string, retire string")
    assert sorted(r["path"] for r in bundles.latest_submissions(up).collect()) == ["3", "4", "5"]


@pytest.mark.parametrize("gap, boots", [(60000, 1), (60001, 2)])
def test_boot_split_is_strict(spark, gap, boots):
    df = spark.createDataFrame([("d", 0, 0), ("d", 100 + gap, 100)], "device_id string, wall_ms long, elapsed_ms long")
    assert timeline.boot_starts([df]).count() == boots
    assert timeline.assign_boot(df, timeline.boot_starts([df])).agg(F.max("boot")).first()[0] == boots - 1


def test_time_weight_is_capped(spark):
    df = spark.createDataFrame([("d", t) for t in (0, 29999, 60000, 100000)], "k string, elapsed_ms long")
    assert [r["weight_ms"] for r in timeline.time_weight(df, ["k"]).orderBy("elapsed_ms").collect()] == [29999, 30000, 30000, 0]


def brute_place(t, fixes):
    prev = max((f for f in fixes if f[0] <= t), default=None)
    after = min((f for f in fixes if f[0] > t), default=None)
    window = lambda v: 10000 if v is None or v < 0 else 120000 if v == 0 else min(120000, max(10000, int(50000 / v)))
    if prev and after and prev[2] == after[2] and after[0] - prev[0] <= 180000:
        return prev[2]
    ok_p, ok_n = prev and t - prev[0] <= window(prev[3]), after and after[0] - t <= window(after[3])
    if ok_p and (not ok_n or t - prev[0] <= after[0] - t):
        return prev[2]
    return after[2] if ok_n else None


def test_locate_against_brute_force(spark):
    rnd = random.Random(4)
    fixes = {d: sorted((rnd.randrange(0, 2_000_000), i, rnd.randrange(3), rnd.choice([None, -1.0, 0.0, 0.3, 2.0, 9.0])) for i in range(30)) for d in "ab"}
    rows = [(d, i, rnd.randrange(0, 2_000_000)) for i, d in enumerate("ab" * 200)]
    f = spark.createDataFrame([(d, *x) for d, v in fixes.items() for x in v], "d string, t long, id long, cell int, speed double")
    r = spark.createDataFrame(rows, "d string, id long, t long")
    got = {x["id"]: x["cell"] for x in timeline.locate(r, f, ["d"], "t", "cell", "speed", radio.speed_window_ms(F.col("speed"))).collect()}
    assert got == {i: brute_place(t, fixes[d]) for d, i, t in rows}


def test_asof_takes_ties_and_age(spark):
    left = spark.createDataFrame([("d", 1, 10), ("d", 2, 9), ("d", 3, 500)], "k string, id int, t long")
    right = spark.createDataFrame([("d", 10, "x")], "k string, t long, v string")
    got = {r["id"]: r["v"] for r in timeline.asof_join(left, right, ["k"], "t", ["v"], max_age=100).collect()}
    assert got == {1: "x", 2: None, 3: None}


def test_percentile_rules_differ(spark):
    hist = spark.createDataFrame([("k", -100, 2), ("k", -90, 2)], "k string, v int, weight long")
    p = lambda mode: stats.percentiles(hist, ["k"], "v", mode, m=0.5).first()["m"]
    assert (p("A"), p("B"), p("C"), p("D"), p("E")) == (-100, -100, -90, -90, -90)


def test_hex_parent_and_neighbours(spark):
    pts = spark.createDataFrame([(1.25 + i * 0.013, 103.6 - i * 0.4) for i in range(60)] + [(-80.0, 179.9), (0.0, 0.0)], "lat double, lng double")
    cells = pts.select("lat", "lng", hexgrid.cell_of(F.col("lat"), F.col("lng"), 10).alias("c"))
    plain = spark.createDataFrame([tuple(r) for r in cells.select("c", hexgrid.centre(F.col("c"))["lat"], hexgrid.centre(F.col("c"))["lng"]).collect()], "c long, lat double, lng double")
    assert plain.where(hexgrid.cell_of(F.col("lat"), F.col("lng"), 10) != F.col("c")).count() == 0
    # of a cell and its six neighbours, exactly seven cells share a centre child's parent
    parents = plain.select("c", hexgrid.parent(F.col("c"), 9).alias("p"), hexgrid.parent(F.col("c"), 6).alias("top")).collect()
    assert all(r["p"] >> 56 & 15 == 9 and r["top"] >> 56 & 15 == 6 for r in parents)
    near = spark.createDataFrame([(hexgrid.TAG + (10 << 56) + (q % (1 << 28) << 28) + r % (1 << 28),) for q in range(-30, 30) for r in range(-30, 30)], "c long")
    sizes = [r["count"] for r in near.groupBy(hexgrid.parent(F.col("c"), 9).alias("p")).count().collect()]
    assert max(sizes) == 7 and sizes.count(7) > 300
    ring = cells.select(F.size(hexgrid.boundary(F.col("c"))).alias("n"), hexgrid.label(F.col("c")).alias("l")).first()
    assert ring["n"] == 7 and ring["l"].startswith("h10:")


def brute_runs(times, gap):
    out = []
    for t in sorted(times):
        if out and t - out[-1][1] <= gap:
            out[-1][1] = t
        else:
            out.append([t, t])
    return [tuple(x) for x in out]


def test_gap_cluster_against_brute_force(spark):
    rnd = random.Random(1)
    times = [rnd.randrange(0, 10_000_000) for _ in range(300)] + [0, 60000, 120001]
    df = spark.createDataFrame([("k", t) for t in times], "k string, t long")
    got = sorted((r["start_ms"], r["end_ms"]) for r in intervals.gap_cluster(df, ["k"], "t", 60000).collect())
    assert got == brute_runs(times, 60000)


def test_pingpong_return_is_spent():
    assert studies.returns_of([0, 10, 20, 30], [1, 2, 1, 2], [2, 1, 2, 1]) == ([True] * 4, [False, True, False, True])
    assert studies.returns_of([0, 30001], [1, 2], [2, 1]) == ([False, False], [False, False])


def test_controls_are_taken_once_and_nearest():
    assert studies.greedy_pairs([(1, 5), (2, 5), (3, 5)], [(10, 4), (11, 6), (12, 5), (13, 9)]) == [(1, 12), (2, 10), (3, 11)]


def test_buckets_merge_in_any_order(spark):
    rnd = random.Random(2)
    rows = spark.createDataFrame([(rnd.choice("ab"), rnd.randrange(0, 20_000_000)) for _ in range(500)], "k string, t long")
    whole = rollup.compact_hour(rows, ["k"], "t")
    parts = rollup.compact_hour(rows.where("t % 2 = 0"), ["k"], "t").union(rollup.compact_hour(rows.where("t % 2 = 1"), ["k"], "t"))
    columns = ["hour", "k", "n", "mask", "first_ms", "last_ms", "minutes"]
    assert sorted(map(tuple, rollup.merge_buckets(parts, ["k"], []).select(columns).collect())) == sorted(map(tuple, whole.select(columns).collect()))
    day = rollup.roll_day(whole, [], ["k"], [])
    assert rollup.roll_day(whole, [], ["k"], [], done=day).count() == 0


def test_outcome_rules_in_order(spark):
    base = {c: 0 for c in bins.SUMS} | {"n": 50, "ms": 600000, "cell_route_n": 10, "cell_route_ms": 1000, "cell_validated_ms": 1000, "flaps": 0, "probe_n": 0, "probe_fail": 0, "cold_n": 0, "cold_fail": 0}
    cases = {"UNSURVEYED": {"n": 7}, "ROUTE_LOSS": {"cell_validated_ms": 799}, "ANCHOR": {"flaps": 17}, "RESELECT": {"cell_changes": 21}, "SLOW": {"probe_n": 20, "probe_fail": 2}, "NSA": {"nr_ms": 300001}, "LTE": {}}
    df = spark.createDataFrame([{"want": k} | base | v for k, v in cases.items()])
    out = bins.classify(bins.measures(df)).collect()
    assert all(r["want"] == r["outcome"] for r in out), [(r["want"], r["outcome"]) for r in out]


def test_slow_latencies_are_the_ninth_rule(spark):
    base = {c: 0 for c in bins.SUMS} | {"n": 50, "ms": 600000, "cell_route_n": 10, "cell_route_ms": 1000, "cell_validated_ms": 1000, "flaps": 0, "probe_n": 4, "probe_fail": 0, "cold_n": 0, "cold_fail": 0}
    cases = [("SLOW", 9, {"ok_n": 3, "p90_ms": 1501}), ("LTE", 0, {"ok_n": 3, "p90_ms": 1500}), ("LTE", 0, {"ok_n": 2, "p90_ms": 9000}), ("SLOW", 9, {"ok_n": 3, "p90_ms": 1501, "nr_ms": 300001}), ("NSA", 10, {"ok_n": 3, "p90_ms": 1500, "nr_ms": 300001})]
    out = bins.classify(bins.measures(spark.createDataFrame([{"want": k, "at": r} | base | v for k, r, v in cases]))).collect()
    assert len(bins.rules()) == 10 and all((r["want"], r["at"]) == (r["outcome"], r["rule"]) for r in out), out


def test_latencies_of_successes_only(spark):
    rows = [(1, v, "OK", True) for v in (100, 200, 200, 1600, 1700)] + [(1, 6000, "FAIL", True), (1, 9000, "OK", False), (2, 50, "FAIL", True)]
    hist = bins.probe_latencies(spark.createDataFrame(rows, "cell long, latency_ms int, outcome string, on_bearer boolean"), ["cell"])
    assert sorted(map(tuple, hist.collect())) == [(1, 100, 1), (1, 200, 2), (1, 1600, 1), (1, 1700, 1)]
    assert [tuple(r) for r in bins.latency_p90(hist, ["cell"]).collect()] == [(1, 5, 1700)]


def test_area_state_holds_its_dwell():
    times = list(range(0, 3_600_000, 10000))
    bad = [t < 1_000_000 for t in times]
    states = devices.area_states(times, bad)
    assert states[0] is False and any(states) and not states[-1]
    first = times[states.index(True)]
    assert min(t for t, s in zip(times, states) if t > first and not s) - first >= 900000


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 'x"y', 5), ("b", 2, "z", 6)], "device_id string, wall_ms long, note string, secret int")
    manifest = tables.export_tables({"t": df}, {"t": ["device_id", "wall_ms", "note"]}, str(tmp_path / "out"))
    assert [tuple(r) for r in manifest.select("table", "rows").collect()] == [("t", 2)]
    back = spark.read.csv(str(tmp_path / "out/t"), header=True, quote='"', escape='"')
    assert back.columns == ["device_id", "wall_ms", "note"] and {r["note"] for r in back.collect()} == {'x"y', "z"}
    buckets = rollup.compact_hour(df, ["device_id"], "wall_ms")
    for _ in range(2):
        tables.write_rollup(buckets, str(tmp_path / "roll"), "hour", "r1")
    assert tables.read_rollup(spark, str(tmp_path / "roll"), "hour").count() == 2


def test_streams_equal_batches(spark, tmp_path):
    rows = [("d", i, 1000 * i, i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, id long, t long, bad boolean")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = pipelines.fold_into(stream, str(tmp_path / "table"), str(tmp_path / "cp"), ["k"], lambda b: b.groupBy("k").agg(F.count("*").alias("n"), F.max("t").alias("last")))
    q.awaitTermination(60)
    assert tuple(pipelines.folded(spark, str(tmp_path / "table"), ["k"], {"n": F.sum("n"), "last": F.max("last")}).first()) == ("d", 200, 199000)
