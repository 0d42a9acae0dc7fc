"""Rows on both sides of the constants of signals, maps, predictions and sessions."""

import time

import pytest
from pyspark.sql import functions as F

from netfathom.functions import hexgrid
from netfathom.operators import devices, intervals, maps, rollup, signals, studies, timeline
from netfathom.sources import tables
from netfathom.streaming import pipelines


def rows(spark, schema, *values):
    return spark.createDataFrame(list(values), schema)


def test_only_probes_on_the_bearer_are_cold(spark):
    df = rows(spark, "d string, id long, wall_ms long, latency_ms int, net string", ("d", 1, 0, 0, "n"), ("d", 2, 30000, 0, "n"), ("d", 3, 60001, 0, "n"), ("d", 4, 200000, 0, ""), ("d", 5, 200001, 0, "n"))
    out = timeline.mark_cold(df, ["d"], on_bearer=F.col("net") != "")
    assert {r["id"]: r["cold"] for r in out.collect()} == {1: True, 2: False, 3: True, 4: False, 5: True}


def test_predictions_have_reasons_and_a_gap(spark):
    s = "d string, id long, t long, rssi int, ok boolean, lost boolean"
    of = lambda *v: {(r["id"], r["reason"]) for r in devices.handover_predictions(rows(spark, s, *v), ["d"], "t", "rssi", "ok", "lost", ["t", "id"]).collect()}
    assert of(("d", 1, 0, -50, True, False), ("d", 2, 9000, -52, True, False), ("d", 3, 20000, -60, True, False)) == {(3, "wifi-falling")}
    assert of(("d", 1, 0, -50, True, False), ("d", 2, 9000, -52, True, False), ("d", 3, 20000, -59, True, False)) == set()
    assert of(("d", 1, 0, -50, True, False), ("d", 3, 20000, -60, True, False)) == set()  # two readings are too few
    assert of(("d", 1, 0, -75, True, False), ("d", 2, 44999, -75, True, False), ("d", 3, 45000, -75, True, False)) == {(1, "wifi-weak"), (3, "wifi-weak")}
    assert of(("d", 1, 0, -50, True, False), ("d", 2, 1, -50, False, False)) == {(2, "wifi-lost-internet")}
    assert of(("d", 1, 0, -50, True, False), ("d", 2, 1, None, True, True), ("d", 3, 50000, -50, False, False)) == {(2, "wifi-lost")}


def test_an_area_ahead_is_bad_only_where_this_one_is_not(spark):
    at = lambda q: hexgrid.TAG + (8 << 56) + (q << 28)
    hours = rows(spark, "cell long, hour int, samples long, below long", (at(1), 5, 10, 5), (at(2), 5, 10, 5), (at(0), 5, 10, 0))
    out = {r["cell"]: (r["bad_here"], r["bad_ahead"]) for r in studies.lookahead(hours.select("cell", "hour"), hours, "cell", hexgrid.neighbours(F.col("cell")), least=5, bad=0.25).collect()}
    assert out == {at(1): (True, False), at(2): (True, False), at(0): (False, True)}


@pytest.mark.parametrize("cold, warm, verdict, contrast", [((9, 0, 100), (20, 0), "too few", False), ((100, 3, 100), (100, 0), "occasional", False), ((100, 20, 100), (100, 0), "failing to wake", True), ((100, 20, 100), (100, 20), "failing", False), ((100, 20, 100), (9, 0), "failing to wake", False), ((100, 0, 1501), (20, 0), "slow", False), ((100, 0, 1500), (20, 0), "healthy", False)])
def test_probe_health(spark, cold, warm, verdict, contrast):
    own = [("d", True, "FAIL" if i < cold[1] else "OK", cold[2]) for i in range(cold[0])] + [("d", False, "FAIL" if i < warm[1] else "OK", 50) for i in range(warm[0])]
    r = devices.probe_health(rows(spark, "d string, cold boolean, outcome string, latency_ms int", *own), ["d"]).first()
    assert (r["verdict"], r["contrast"]) == (verdict, contrast)


def test_overlaps_touch_at_their_ends(spark):
    deg = rows(spark, "d string, start_ms long, end_ms long, n int", ("d", 0, 9, 1), ("d", 0, 10, 2), ("d", 20, 30, 3), ("d", 31, 40, 4), ("e", 0, 99, 5))
    out = rows(spark, "d string, start_ms long, end_ms long", ("d", 10, 15), ("d", 25, 30))
    assert sorted(r["n"] for r in intervals.suppress_overlaps(deg, out, ["d"]).collect()) == [1, 4, 5]


def test_quality_flags_sit_on_the_clamps(spark):
    base = {"rsrp": -100, "rsrq": -10, "rssnr": 5, "ta": 1282, "cqi": 15, "ci": 1, "pci": None, "cell_age_ms": 120000, "ss_rsrp": None, "ss_rsrq": None, "ss_sinr": None, "band_ambiguous": False, "band_reported": 3, "band_derived": 3, "withheld": False}
    cases = {0: {}, 1: {"rsrp": -43}, 2: {"rsrq": 3}, 4: {"rssnr": -20}, 8: {"ta": 1283}, 16: {"cqi": 16}, 32: {"cell_age_ms": 120001}, 64: {"ss_sinr": 40}, 128: {"band_ambiguous": True}, 256: {"band_derived": 7}, 512: {"withheld": True}, 5: {"rsrp": -140, "rssnr": 30}}
    schema = "want int, rsrp int, rsrq int, rssnr int, ta int, cqi int, ci int, pci int, cell_age_ms int, ss_rsrp int, ss_rsrq int, ss_sinr int, band_ambiguous boolean, band_reported int, band_derived int, withheld boolean"
    out = signals.quality_flags(spark.createDataFrame([(k, *(base | v).values()) for k, v in cases.items()], schema)).collect()
    assert all(r["want"] == r["flags"] for r in out)


def test_kinds_names_and_weeks(spark):
    p = rows(spark, "t string, e string", ("BINDFAIL", None), ("TCP", "Binding socket x"), ("TLS6", "no cellular network"), ("STALL", ""), ("UP8K", None), ("DNS", "x"), ("PING", None))
    assert [r[0] for r in p.select(signals.probe_kind(F.col("t"), F.col("e"))).collect()] == ["INSTRUMENT", "INSTRUMENT", "NO_BEARER", "RECOVERY", "TRANSFER", "REACHABILITY", "UNKNOWN"]
    days = rows(spark, "ms long", (1798761600000,), (1767139200000,))
    assert [r[0] for r in days.select(maps.iso_week(F.col("ms"))).collect()] == ["2026-W53", "2026-W01"]


def test_holds_last_a_keep_alive(spark):
    df = rows(spark, "d string, id long, t long, active boolean, trigger string, sent boolean", ("d", 1, 0, True, "a", True), ("d", 2, 4999, True, "b", True), ("d", 3, 9999, False, None, False), ("d", 4, 20000, True, "b", False), ("d", 5, 40001, True, "b", True))
    out = signals.holding_sessions(df, ["d"], "t", ["t", "id"]).collect()
    assert [(r["trigger"], r["start_ms"], r["held_ms"], r["warm_ms"], r["gaps_lower"], r["gaps_upper"]) for r in sorted(out, key=lambda r: r["start_ms"])] == [("b", 4999, 5000, 5000, 0, 0), ("b", 20000, 20001, 5000, 1, 2)]


def test_journeys_are_judged_from_five_changes_on(spark):
    df = rows(spark, "coverage double, failed long, clean long, want string", (0.29, 9, 9, "unreadable"), (0.3, 2, 2, "too few"), (1.0, 2, 6, "bad"), (1.0, 1, 9, "watch"), (1.0, 1, 10, "clean"))
    assert all(r["want"] == r["verdict"] for r in maps.journey_verdict(df).collect())


def test_finer_leaves_go_to_the_coarsest_of_their_network(spark):
    fine = hexgrid.TAG + (10 << 56)
    up = spark.range(1).select(*[hexgrid.parent(F.lit(fine), r).alias(f"p{r}") for r in (9, 8)]).first()
    leaves = rows(spark, "cell long, plmn string, n long", (fine, "a", 1), (up["p9"], "a", 10), (up["p8"], "a", 100), (fine, "b", 1000))
    assert {(r["cell"], r["plmn"]): (r["n"], r["units"], r["leaves"]) for r in maps.collapse_overlaps(leaves).collect()} == {(up["p8"], "a"): (111, 49, 3), (fine, "b"): (1000, 1, 1)}


def test_what_is_delivered_twice_counts_once(spark):
    df = rows(spark, "id long, k string, t long", *[(i, "k", i * 60000) for i in range(100)])
    once = rollup.compact_once(None, df.where("id < 50"), ["k"], "t")
    twice = rollup.compact_once(rollup.compact_once(once, df.where("id < 50"), ["k"], "t"), df, ["k"], "t")
    want = rollup.compact_hour(df, ["k"], "t")
    columns = ["hour", "k", "n", "mask", "minutes"]
    assert sorted(map(tuple, twice.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_streams_of_masts_and_bins_equal_batches(spark, tmp_path):
    df = rows(spark, "cell long, sub_id int, plmn string, enb long, band int, sinr int, wall_ms long, weight_ms long", *[(i % 3, 0, "p", i % 2, 1, i % 7 - 3, i * 1000000, 10) for i in range(90)])
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    keys = ["plmn", "enb", "band"]
    pipelines.stream_sites(stream(), str(tmp_path / "s"), str(tmp_path / "cs"), keys).awaitTermination(60)
    want = studies.site_hours(df, keys, F.floor(F.col("wall_ms") / 3600000) % 24)
    assert sorted(map(tuple, pipelines.sites(spark, str(tmp_path / "s"), keys).select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_fixes_are_admitted(spark):
    s = "d string, id long, wall_ms long, t long, now long, accuracy_m double, lat double, mock boolean"
    df = rows(
        spark, s, ("d", 1, 1, 100, 60100, 300.0, 0.0, False), ("d", 2, 2, 200, 60201, 9.0, 0.0, False), ("d", 3, 3, 5000, 4000, 9.0, 0.0, None), ("d", 4, 4, 5000, 5000, 9.0, 0.0, False), ("d", 5, 5, 9001, 8000, 9.0, 0.0, False),
        ("d", 6, 6, 7000, 7000, 301.0, 0.0, False), ("d", 7, 7, 6000, 6000, 9.0, 0.0, False), ("d", 8, 8, 8000, 8000, 299.0, 60.0, False), ("d", 9, 9, 9000, 9000, 9.0, 0.0, True), ("d", 10, 10, None, 9000, 9.0, 0.0, False), ("d", 11, 11, 9000, 9000, None, 0.0, False),
    )
    out = {r["id"]: r["reject"] for r in timeline.admit_fixes(df, ["d"], "t", mock="mock", now="now").collect()}
    # neither what is too coarse (6) nor what is made up (9) stands in the way of an earlier one
    assert out == {1: None, 2: "stale", 3: None, 4: "order", 5: "stale", 6: "accuracy", 7: None, 8: "accuracy", 9: "mock", 10: "stale", 11: "accuracy"}


def test_serving_changes_take_fresh_rows(spark):
    s = "d string, id long, rat string, ci long, mode string, level int"
    df = rows(spark, s, ("d", 1, "LTE", 256, "push", 1), ("d", 2, "LTE", 257, "push", 1), ("d", 3, "LTE", 257, "poll", 1), ("d", 4, "NR", None, "poll", 1), ("d", 5, "LTE", 600, "push", 1), ("d", 6, "NR", 601, "poll", 1), ("d", 7, "LTE", 602, "push", 1))
    out = [tuple(r) for r in intervals.serving_changes(df, ["d"], ["id"], ["rat", "ci", "level"]).select("id", "before", "kind", "poll_derived").orderBy("id").collect()]
    assert out == [(2, 256, "sector", False), (5, 257, "mast", False), (6, 600, "undecomposable", True), (7, 601, "undecomposable", True)]


def test_observed_wins_in_merged_intervals(spark):
    df = rows(spark, "d string, start_ms long, end_ms long, observed boolean", ("d", 0, 5, False), ("d", 10005, 10010, True), ("d", 20011, 20012, False))
    out = sorted((r["start_ms"], r["end_ms"], r["n"], r["observed"]) for r in intervals.merge_intervals(df, ["d"], observed="observed").collect())
    assert out == [(0, 10010, 2, True), (20011, 20012, 1, False)]


@pytest.mark.parametrize("n, failed, led, spread, up, gate", [(9, 0, 5, 0, 200, "too few"), (40, 11, 20, 0, 200, "incomplete"), (40, 10, 20, 0, 200, "uplink slower"), (40, 0, 11, 0, 200, "confounded"), (40, 0, 12, 0, 50, "downlink slower"), (40, 0, 20, 1, 100, "no asymmetry"), (12, 0, 6, 2, 100, "too variable")])
def test_asymmetry_has_gates(spark, n, failed, led, spread, up, gate):
    legs = []
    for i in range(n):
        pair = [("DOWN", 100, "OK"), ("UP", up * 10 ** (spread * (i % 2 * 2 - 1)) if spread == 2 else up + spread * (i % 2 * 2 - 1), "FAIL" if i < failed else "OK")]
        legs += [(2 * i + k, *x) for k, x in enumerate(pair if i < led else pair[::-1])]
    df = rows(spark, "id long, direction string, latency_ms int, outcome string", *[(a, b, int(c), o) for a, b, c, o in legs])
    pairs = rows(spark, "first_id long, second_id long", *[(2 * i, 2 * i + 1) for i in range(n)])
    r = studies.asymmetry(pairs, df).first()
    assert r["gate"] == gate and r["up_failed"] == failed and r["down_ms"] == 100


def test_values_are_confirmed_alike_in_streams(spark, tmp_path):
    values = [("d", i, i * 1000, "ab"[i // 7 % 2] if i % 4 else None) for i in range(60)] + [("e", 99, 0, "a"), ("e", 100, 4999, "a"), ("e", 101, 5000, "a"), ("e", 102, 5001, "b"), ("e", 103, 5002, "a"), ("e", 104, 10002, "a")]
    df = rows(spark, "d string, id long, t long, v string", *values)
    want = {tuple(r) for r in devices.confirmed(df, ["d"], "t", "v", ["t", "id"], 5000).collect()}
    assert ("e", "a", 0, 5000) in want and len([w for w in want if w[0] == "e"]) == 1 and len(want) > 4
    for part in (df.where("t < 5001"), df.where("t >= 5001")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = pipelines.confirmed_stream(stream, ["d"], "t", "v", 5000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("d", "v", "since_ms", "at_ms").collect()} == want


def test_faults_freshness_and_kinds(spark):
    f = rows(spark, "d string, end_ms long", ("d", 100), ("d", 900000), ("d", 950000))
    out = [(r["end_ms"], r["active"], r["place"]) for r in devices.order_faults(f, ["d"], F.lit(1000000 + 800000)).orderBy("place").collect()]
    assert out == [(950000, True, 1), (900000, False, 2), (100, False, 3)] and devices.order_faults(f, ["d"], F.lit(86400101)).count() == 2
    r = devices.freshness(rows(spark, "signal_ms long, service_ms long, cell_ms long", (985000, 399999, None)), F.lit(1000000)).first()
    assert (r["signal_stale"], r["service_stale"], r["cell_stale"]) == (False, True, True)
    kinds = rows(spark, "c string", ("Slaac failed",), ("unknown",), ("unknown address",), ("refused",), (None,)).select(devices.fault_kind(F.col("c"))).collect()
    assert [k[0] for k in kinds] == ["IPV6_CONFIG_FAILURE", "UNKNOWN", "IPV6_CONFIG_FAILURE", "REPEATED_SETUP_FAILURE", "REPEATED_SETUP_FAILURE"]


def test_tagged_lines_and_formats(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/h1").write_text('{"period": 1}\n{"k": "r", "n": 2}\n{"k": "r", "n"\n{"k": "p", "ok": 3}\n')
    (tmp_path / "h2").write_text('{"k": "r", "n": 5}\nnoise\n{"k": "z", "n": 7}\n')
    found = tables.read_tagged(spark, str(tmp_path), {"r": "n long", "p": "ok long"})
    assert sorted(r["n"] for r in found["r"].collect()) == [2, 5] and [r["ok"] for r in found["p"].collect()] == [3]
    cells, stats, names = rows(spark, "network string, area string", ("1-1", "12")), rows(spark, "cells_seen long", (1,)), rows(spark, "plmn string, name string", ("1-1", "a"))
    tables.publish_shared_map(cells, stats, names, str(tmp_path / "map"))
    assert [r["cell"] for r in tables.read_shared_map(spark, str(tmp_path / "map")).collect()] == [12]
    with pytest.raises(ValueError):
        tables.read_shared_map(spark, str(tmp_path / "map"), "another")


def test_holds_end_alike_in_streams(spark, tmp_path):
    rows = [(i % 2, i * 1500, i % 40 < 31, None if i % 23 == 0 else "ab"[i // 20 % 2], None if i % 5 == 0 else i % 3 > 0) for i in range(240)]
    rows += [(d, 400000, None if d else False, "a", True) for d in (0, 1)]  # ends what is open
    schema = "d int, t long, active boolean, trigger string, sent boolean"
    for k in range(0, len(rows), 61):
        spark.createDataFrame(rows[k : k + 61], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are read in order of their times
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = pipelines.holding_stream(stream, ["d"], "t").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination(60)
    want = signals.holding_sessions(spark.createDataFrame(rows, schema), ["d"], "t", ["t"])
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, want.collect())) and want.count() > 4


@pytest.mark.parametrize(("n", "bad", "verdict"), [(19, 19, "invalid"), (20, 0, "invalid"), (20, 1, "no association"), (20, 20, "harmful")])
def test_verdicts_need_pairs_and_failures(spark, n, bad, verdict):
    kinds = ["sector", "undecomposable"]
    values = [(2 * i + k, f"d{2 * i + k}", 100000, i, kinds[i % 2]) for i in range(n) for k in (0, 1)]
    changes = rows(spark, "id long, d string, wall_ms long, churn long, kind string", *values)
    fails = rows(spark, "d string, wall_ms long", ("other", 0), *[(f"d{2 * i}", 64000 if i % 2 else 106000) for i in range(bad)], *[(f"d{2 * i + 1}", 106001) for i in range(n)])
    pairs = rows(spark, "case_id long, control_id long", *[(2 * i, 2 * i + 1) for i in range(n)])
    found = {r["label"]: r for r in studies.verdicts(pairs, changes, fails, ["d"]).collect()}
    whole = found["overall"]
    assert set(found) == {"overall", "sector"} and (whole["pairs"], whole["case_failed"], whole["control_failed"], whole["verdict"]) == (n, bad, 0, verdict)
    assert whole["case_churn"] == n // 2 and found["sector"]["pairs"] == (n + 1) // 2
