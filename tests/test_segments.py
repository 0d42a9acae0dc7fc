"""Scans along a key's time by segments: equal to plain scans, and linear in the rows of one key."""

import random
import time

import pytest
from pyspark.sql import functions as F

from netfathom.functions import radio
from netfathom.operators import intervals, segments, timeline


def some_rows(seed, n=400):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", "c"]), rnd.choice([None] + [rnd.randrange(0, 5000) for _ in range(12)]), i, rnd.choice([None, None, rnd.randrange(9)])) for i in range(n)]


@pytest.mark.parametrize("span", [7, 100, 10**9])
@pytest.mark.parametrize("own", [True, False])
def test_along_equals_a_scan(spark, span, own):
    rows = [r for r in some_rows(span) if r[1] is not None]
    df = spark.createDataFrame(rows, "k string, t long, id long, v long")
    value = F.when(F.col("v") > 2, F.col("v"))
    got = {(r["id"], r["p"], r["n"], r["m"]) for r in segments.along(df, ["k"], "t", ["t", "id"], last={"p": value}, upcoming={"n": F.col("v"), "m": F.col("t")}, own=own, span_ms=span).collect()}
    want = set()
    for k in "abc":
        line = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        for i, r in enumerate(line):
            before = [x[3] for x in line[: i + own] if x[3] is not None and x[3] > 2]
            after = [x[3] for x in line[i + 1 :] if x[3] is not None]
            want.add((r[2], before[-1] if before else None, after[0] if after else None, line[i + 1][1] if i + 1 < len(line) else None))
    assert got == want


def test_null_keys_and_times(spark):
    df = spark.createDataFrame([("a", None, 1, 5), ("a", 10, 2, None), (None, 10, 3, 4), (None, 20, 4, None), ("a", 30, 5, 7)], "k string, t long, id long, v long")
    got = {r["id"]: (r["p"], r["n"]) for r in segments.along(df, ["k"], "t", ["t", "id"], last={"p": F.col("v")}, upcoming={"n": F.col("v")}, span_ms=5).collect()}
    assert got == {1: (5, None), 2: (None, 7), 3: (4, None), 4: (None, None), 5: (7, None)}
    assert segments.along(df.limit(0), ["k"], "t", ["t", "id"], last={"p": F.col("v")}).count() == 0


def plain_locate(rows, fixes, window):
    out = {}
    for k, t, i in rows:
        line = sorted((f for f in fixes if f[0] == k), key=lambda f: (f[1], f[2]))
        p = next((f for f in reversed(line) if f[1] <= t), None)
        n = next((f for f in line if f[1] > t), None)
        if p and n and p[3] == n[3] and n[1] - p[1] <= 180000:
            speeds = [x[4] for x in (p, n) if x[4] is not None]
            out[i] = (p[3], sum(speeds) / len(speeds) if speeds else None)
            continue
        ok_p, ok_n = p is not None and t - p[1] <= window(p[4]), n is not None and n[1] - t <= window(n[4])
        near = p if ok_p and (not ok_n or t - p[1] <= n[1] - t) else n if ok_n else None
        out[i] = (near[3], near[4]) if near else (None, None)
    return out


@pytest.mark.parametrize("span", [200_000, 3_600_000])
def test_locate_over_the_edges_of_spans(spark, span):
    rnd = random.Random(span)
    fixes = [(rnd.choice("ab"), rnd.randrange(0, 3_000_000), i, rnd.randrange(3), rnd.choice([None, -1.0, 0.0, 0.3, 1.0, 20.0])) for i in range(90)]
    rows = [(rnd.choice("abc"), rnd.randrange(0, 3_100_000), i) for i in range(300)] + [("a", k * 200_000 + d, 1000 + 3 * k + d) for k in range(15) for d in (-1, 0, 1)]
    window = lambda v: 10000 if v is None or v < 0 else 120000 if v == 0 else min(120000, max(10000, int(50000 / v)))
    f = spark.createDataFrame(fixes, "k string, t long, id long, cell long, speed double")
    r = spark.createDataFrame(rows, "k string, t long, id long")
    got = {x["id"]: (x["cell"], x["speed"]) for x in timeline.locate(r, f, ["k"], "t", "cell", "speed", radio.speed_window_ms(F.col("speed")), span_ms=span).collect()}
    assert got == plain_locate(rows, fixes, window)


@pytest.mark.parametrize("span", [50, 10**9])
def test_weights_routes_and_cold_probes_over_segments(spark, span):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), t, i) for i, t in enumerate(rnd.sample(range(3000), 120))]
    right = [(rnd.choice("ab"), t, f"v{t}") for t in rnd.sample(range(3000), 40)]
    left = spark.createDataFrame(rows, "k string, t long, id long")
    weights = {r["id"]: r["weight_ms"] for r in timeline.time_weight(left, ["k"], "t", ["id"], cap_ms=20, span_ms=span).collect()}
    states = {r["id"]: (r["v"], r["o"]) for r in timeline.asof_join(left, spark.createDataFrame(right, "k string, t long, v string").withColumn("o", F.col("t")), ["k"], "t", ["v", "o"], span_ms=span).collect()}
    cold = {r["id"]: r["cold"] for r in timeline.mark_cold(left.withColumn("latency_ms", F.col("id") % 7), ["k"], "t", on_bearer=F.col("id") % 3 > 0, gap_ms=30, span_ms=span).collect()}
    for k, t, i in rows:
        later = [x[1] for x in rows if x[0] == k and x[1] > t]
        assert weights[i] == (min(20, min(later) - t) if later else 0)
        before = max((x[1] for x in right if x[0] == k and x[1] <= t), default=None)
        assert states[i] == ((f"v{before}", before) if before is not None else (None, None))
        last = max((x[1] for x in rows if x[0] == k and x[1] < t and x[2] % 3 > 0), default=None)
        assert cold[i] == (i % 3 > 0 and (last is None or t - i % 7 - last > 30))


def test_overlaps_against_all_pairs(spark):
    rnd = random.Random(4)
    make = lambda n: [(rnd.choice("ab"), s, s + rnd.randrange(0, 40)) for s in (rnd.randrange(0, 900) for _ in range(n))]
    bad, out = make(120), make(25)
    schema = "k string, start_ms long, end_ms long"
    got = sorted(tuple(r) for r in intervals.suppress_overlaps(spark.createDataFrame(bad, schema), spark.createDataFrame(out, schema), ["k"]).collect())
    assert got == sorted(b for b in bad if not any(o[0] == b[0] and o[1] <= b[2] and b[1] <= o[2] for o in out))


def hot(spark, n):
    """Rows of one device, a fix every fifth second."""
    rows = spark.range(n).select(F.lit("d").alias("k"), (F.col("id") * 1000).alias("t"), "id")
    fixes = rows.where("id % 5 = 0").select("k", "t", "id", (F.col("id") % 40).alias("cell"), (F.col("id") % 3).cast("double").alias("speed"))
    return rows, fixes


def test_one_device_of_a_million_rows(spark):
    def seconds(n):
        rows, fixes = hot(spark, n)
        began = time.time()
        out = timeline.locate(rows, fixes, ["k"], "t", "cell", "speed", radio.speed_window_ms(F.col("speed")))
        found = out.agg(F.count("cell"), F.count("*")).first()
        took = time.time() - began
        assert tuple(found) == (n, n)
        return took

    seconds(1000)
    half, whole = seconds(500_000), seconds(1_000_000)
    assert whole < 20 and whole < 3 * half + 2


def test_a_hot_device_is_shared_by_tasks(spark):
    rows, fixes = hot(spark, 200_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = timeline.asof_join(rows, fixes, ["k"], "t", ["cell"], span_ms=3_600_000)
        per = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(per) == 200_000 and max(per) < 150_000
    assert out.where("cell is null").count() == 0
    overlap = spark.range(40_000).select(F.lit("d").alias("k"), (F.col("id") * 10).alias("start_ms"), (F.col("id") * 10 + 3).alias("end_ms"))
    began = time.time()
    assert intervals.suppress_overlaps(overlap, overlap.where("start_ms % 7 = 0"), ["k"]).count() == overlap.where("start_ms % 7 <> 0").count()
    assert time.time() - began < 20
