"""Faults against a machine that looks at each moment; rules in event time against tables, whatever the arrival and the batches."""

import random

import pytest
from pyspark.sql import functions as F

from netfathom.functions import radio
from netfathom.operators import devices, faults, timeline
from netfathom.streaming import ordered
from test_segments import plain_locate


def machine(failures, as_of, window, least, sustained, quiet, valid):
    """One look at each moment: (first, last, cleared) of the faults."""
    out, fault, times = [], None, []
    for now in range(as_of + 1):
        holds = lambda: [x for x in times if now - x <= window]
        fires = lambda own: len(own) >= least and own[-1] - own[0] >= sustained
        if fault and not fires(holds()) and now - fault[1] > quiet:
            out.append((*fault, now - 1))
            fault = None
        if now in failures:
            times.append(now)
            own = holds()
            if fires(own):
                fault = (fault[0] if fault else own[0], now)
    return out + ([(*fault, None)] if fault else [])


LIMITS = {"window": 60, "least": 3, "sustained": 5, "quiet": 15, "valid": 20}


def some_failures(seed):
    rnd = random.Random(seed)
    t, out = 0, []
    while t < 900:
        t += rnd.choice([1, 2, 3, 8, 14, 15, 16, 17, 40, 90])
        out.append(t)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_faults_equal_a_machine_of_moments(spark, seed):
    times = some_failures(seed)
    df = spark.createDataFrame([("a", t, i) for i, t in enumerate(times)], "k string, t long, id long")
    none = spark.createDataFrame([], "k string, t long, told int, cause string")
    got = sorted((r["first_ms"], r["last_ms"], r["cleared_ms"]) for r in faults.carrier_faults(df, none, ["k"], "t", 1000, ["id"], forget=10**9, **LIMITS).collect())
    want = machine(times, 1000, **LIMITS)
    assert got == sorted(want, key=lambda f: (f[0], f[1])) and len(want) > 3


def test_evidence_opens_names_and_ages(spark):
    df = spark.createDataFrame([("a", t, t) for t in (100, 103, 106, 110)], "k string, t long, id long")
    told = spark.createDataFrame([("a", 108, 2, "x"), ("a", 112, 9, "SLAAC timeout"), ("b", 50, 5, "Error_Unspecified"), ("b", 60, 1, None), ("c", 10, 2, "no")], "k string, t long, told int, cause string")
    got = {(r["k"], r["first_ms"], r["last_ms"], r["n"], r["cause"], r["kind"], r["cleared_ms"]) for r in faults.carrier_faults(df, told, ["k"], "t", 500, ["id"], **LIMITS).collect()}
    # of b the later evidence, which told less, still counts as the larger number; a's failures hold it up to 103 + 60
    assert got == {("a", 100, 112, 9, "SLAAC timeout", "IPV6_CONFIG_FAILURE", 163), ("b", 50, 60, 5, "Error_Unspecified", "UNKNOWN", 80)}
    assert faults.carrier_faults(df.limit(0), told.limit(0), ["k"], "t", 500).count() == 0
    assert faults.carrier_faults(df, told, ["k"], "t", 500, ["id"], **{**LIMITS, "forget": 100}).count() == 0


def test_short_lived_connections(spark):
    rows = [(0, "DISCONNECTED", None), (10, "CONNECTED", True), (15, "CONNECTED", True), (30, "DISCONNECTED", True), (31, "DISCONNECTED", True), (40, "CONNECTED", True), (300, "DISCONNECTED", True), (310, "SUSPENDED", True), (320, "DISCONNECTED", True), (330, "CONNECTED", True), (340, "DISCONNECTED", False), (None, "DISCONNECTED", True)]
    df = spark.createDataFrame([("a", t, i, s, up) for i, (t, s, up) in enumerate(rows)], "k string, t long, id long, state string, up boolean")
    assert sorted(r["t"] for r in faults.short_lived(df, ["k"], "t", "state", "up", ["id"], settled_ms=120).collect()) == [0, 30, 320]


def streamed(spark, folder, rows, schema, make, seed, lateness=60_000, files=4):
    """What a stream tells of rows that come late by less than the lateness, cut into files; the last row only moves the time."""
    rnd = random.Random(seed)
    t = [f.strip().split(" ")[0] for f in schema.split(",")].index("t")
    come = sorted(rows, key=lambda r: r[t] + rnd.randrange(0, lateness))
    cuts = sorted(rnd.sample(range(1, len(come)), files - 1))
    ends = [tuple("end" if n == 0 else 10**10 if n == t else None for n in range(len(rows[0])))]
    for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(come)])):
        spark.createDataFrame(come[a:b], schema).coalesce(1).write.parquet(f"{folder}/in/{i:03}")
    spark.createDataFrame(ends, schema).coalesce(1).write.parquet(f"{folder}/in/{files:03}")
    ordered.use_state_store(spark)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    query = make(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None
    return [tuple(r) for r in spark.read.parquet(f"{folder}/out").where("k <> 'end'").collect()]


def test_area_state_in_event_time(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(k, t, i, (t // 400_000) % 2 == 0 and rnd.random() < 0.9) for k in "ab" for i, t in enumerate(sorted(rnd.sample(range(0, 4_000_000), 250)))]
    schema, limits = "k string, t long, id long, bad boolean", {"window": 300_000, "least": 8, "dwell": 200_000}
    df = spark.createDataFrame(rows, schema)
    states = devices.area_state(df, ["k"], "t", "bad", ["t", "id"], **limits).collect()
    want = []
    for k in "ab":
        was = False
        for r in sorted((r for r in states if r["k"] == k), key=lambda r: (r["t"], r["id"])):
            if r["poor"] != was:
                want.append((k, r["t"], r["poor"]))
                was = r["poor"]
    assert len(want) > 4
    got = streamed(spark, tmp_path, rows, schema, lambda s: ordered.ordered(s, ["k"], "t", ["id"], ordered.Area("bad", **limits), "60 seconds"), 1)
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("seed", [5, 6])
def test_bins_of_a_stream_add_up_to_those_of_a_table(spark, tmp_path, seed):
    rnd = random.Random(seed)
    fixes = [(rnd.choice("ab"), t, i, rnd.randrange(3), rnd.choice([None, -1.0, 0.0, 0.3, 1.0, 20.0])) for i, t in enumerate(rnd.sample(range(0, 2_000_000), 50))]
    links = [(rnd.choice("ab"), t, i, rnd.choice(["WIFI", "CELLULAR"]), rnd.random() < 0.7) for i, t in enumerate(rnd.sample(range(0, 2_000_000), 20))]
    samples = [(rnd.choice("ab"), t, i, i % 2) for i, t in enumerate(rnd.sample(range(0, 2_100_000), 150))]
    reach = lambda v: 10000 if v is None or v < 0 else 120000 if v == 0 else min(120000, max(10000, int(50000 / v)))
    schema = "k string, t long, place int, id long, kind string, cell long, speed double, reach long, transport string, validated boolean, not_suspended boolean, sub_id int"
    rows = [(k, t, 1, i, "fix", c, v, reach(v), None, None, None, None) for k, t, i, c, v in fixes]
    rows += [(k, t, 0, i, "link", None, None, None, how, ok, True, None) for k, t, i, how, ok in links]
    rows += [(k, t, 2, i, "sample", None, None, None, None, None, None, sub) for k, t, i, sub in samples]
    got = streamed(spark, tmp_path, rows, schema, lambda s: ordered.ordered(s, ["k"], "t", ["place", "id"], ordered.Bins(), "60 seconds"), seed)
    # the batch form, on the same rows
    left = spark.createDataFrame(samples, "k string, t long, id long, sub_id int")
    weighted = timeline.time_weight(left, ["k", "sub_id"], "t", ["id"])
    routed = timeline.asof_join(weighted, spark.createDataFrame(links, "k string, t long, lid long, transport string, validated boolean"), ["k"], "t", ["transport", "validated"])
    placed = timeline.locate(routed, spark.createDataFrame(fixes, "k string, t long, id long, cell long, speed double"), ["k"], "t", "cell", "speed", radio.speed_window_ms(F.col("speed"))).where("cell is not null")
    assert {r["id"]: (r["cell"], r["speed"]) for r in placed.collect()} == {i: v for i, v in plain_locate([(k, t, i) for k, t, i, _ in samples], fixes, reach).items() if v[0] is not None}
    want = {(r["k"], r["cell"], r["sub_id"], r["transport"], r["validated"]): (r["n"], r["ms"], r["speed_ms"]) for r in placed.groupBy("k", "cell", "sub_id", "transport", "validated").agg(F.count("*").alias("n"), F.sum("weight_ms").alias("ms"), F.round(F.sum(F.coalesce("speed", F.lit(0.0)) * F.col("weight_ms")), 3).alias("speed_ms")).collect()}
    sums = {}
    for k, _id, sub, cell, speed, how, ok, _, n, w in got:
        a = sums.setdefault((k, cell, sub, how, ok), [0, 0, 0.0])
        a[0], a[1], a[2] = a[0] + n, a[1] + w, a[2] + (speed or 0.0) * w
    assert {k: (n, w, round(x, 3)) for k, (n, w, x) in sums.items()} == want


def test_faults_open_and_clear_in_event_time(spark, tmp_path):
    limits = {"window": 60_000, "least": 3, "sustained": 5_000, "quiet": 15_000, "valid": 20_000}
    rows = [(k, 1000 * t, i, None) for k, seed in (("a", 1), ("b", 2)) for i, t in enumerate(some_failures(seed))] + [("a", 333_000, 900, 7), ("c", 50_000, 901, 4), ("c", 60_000, 902, 1)]
    schema = "k string, t long, id long, told int"
    df = spark.createDataFrame(rows, schema)
    batch = faults.carrier_faults(df.where("told is null"), df.where("told is not null").withColumn("cause", F.lit(None).cast("string")), ["k"], "t", 10**9, ["id"], forget=10**12, **limits)
    want = sorted((r["k"], r["cleared_ms"], r["first_ms"], r["last_ms"], r["n"]) for r in batch.collect())
    got = streamed(spark, tmp_path, rows, schema, lambda s: ordered.ordered(s, ["k"], "t", ["id"], ordered.Faults(**limits), "60 seconds"), 2)
    assert sorted((k, t, a, b, n) for k, what, t, a, b, n in got if what == "cleared") == want
    assert sum(what == "opened" for _, what, *_ in got) == len(want)


def test_values_are_confirmed_when_their_time_is_over(spark, tmp_path):
    rnd = random.Random(8)
    rows = [(k, t, i, rnd.choice([None, "x", "x", "y"])) for k in "ab" for i, t in enumerate(sorted(rnd.sample(range(0, 900_000), 90)))]
    schema = "k string, t long, id long, v string"
    got = streamed(spark, tmp_path, rows, schema, lambda s: ordered.ordered(s, ["k"], "t", ["id"], ordered.Confirmed("v", "string", 20_000), "60 seconds"), 4)
    want = [(k, *x) for k in "ab" for x in ordered.along([dict(zip(("k", "t", "id", "v"), r)) for r in rows if r[0] == k], ordered.Confirmed("v", "string", 20_000), "t", ["id"])]
    assert sorted(got) == sorted(want) and len(want) > 6
    for k, v, since, at in want:
        own = [r for r in rows if r[0] == k and r[3] is not None and since <= r[1] < at]
        assert at == since + 20_000 and {r[3] for r in own} == {v}


def test_alerts_keep_quiet(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(k, t, i) for k in "ab" for i, t in enumerate(sorted(rnd.sample(range(0, 900_000), 60)))]
    df = spark.createDataFrame(rows, "k string, t long, id long")
    want = sorted((r["k"], r["t"], r["id"]) for r in devices.throttled(df, ["k"], "t", ["t", "id"], 45_000).collect())
    got = streamed(spark, tmp_path, rows, "k string, t long, id long", lambda s: ordered.ordered(s, ["k"], "t", ["id"], ordered.Quiet(45_000), "60 seconds"), 4, files=6)
    assert sorted(got) == want
