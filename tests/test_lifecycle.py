"""Stored rows through losses at any step: the same tables in the end as without one."""

import pytest
from pyspark.sql import functions as F

from netfathom.operators import rollup
from netfathom.sources import lifecycle
from netfathom.sources.lifecycle import Rule, Store, apply_retention, compact, deliver, erase

DAY = rollup.DAY_MS
RULE = Rule(lambda rows: rollup.compact_hour(rows, ["k", "ci"], "t"), lambda hours: rollup.roll_day(hours, ["k"], ["ci"], []))


def rows_of(spark, ids):
    return spark.createDataFrame([(i, f"d{i % 7}", i % 2, i % 5, (i % 10) * DAY + i * 1000) for i in ids], "id long, device_id string, k int, ci int, t long")


class Lost(Exception):
    pass


def state(store):
    """What the tables hold, by tier."""
    raw, hour, day = (store.table(x, "radio") for x in ("raw", "hour", "day"))
    return {
        "raw": sorted(r["id"] for r in raw.collect()) if raw else [],
        "hour": sorted((r["hour"], r["k"], r["ci"], r["n"]) for r in rollup.merge_buckets(hour, ["k", "ci"], []).collect()) if hour else [],
        "day": sorted((r["day"], r["k"], r["n"], r["cells"], r["hours"]) for r in day.collect()) if day else [],
    }


def life(store, spark):
    deliver(store, "a", {"radio": rows_of(spark, range(0, 300))}, t="t")
    deliver(store, "b", {"radio": rows_of(spark, range(300, 400))}, t="t")
    apply_retention(store, {"radio": RULE}, 11 * DAY, 1 << 60, raw_days=3, hour_days=7)


@pytest.fixture(scope="module")
def whole(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("whole")))
    life(store, spark)
    return state(store)


def test_rows_move_on_by_their_age(whole):
    assert {i % 10 for i in whole["raw"]} == {d for d in range(10) if 11 - d <= 3}
    assert {h // DAY for h, *_ in whole["hour"]} == {d for d in range(10) if 3 < 11 - d <= 7}
    assert {d // DAY for d, *_ in whole["day"]} == {d for d in range(10) if 11 - d > 7}
    assert len(whole["raw"]) + sum(x[3] for x in whole["hour"]) + sum(x[2] for x in whole["day"]) == 400


@pytest.mark.parametrize("step, when", [(0, "before"), (1, "before"), (2, "before"), (3, "before"), (1, "after"), (2, "after"), (3, "after"), (2, "half")])
def test_a_run_that_is_lost_is_finished_by_the_next(spark, tmp_path, whole, monkeypatch, step, when):
    store, count, real = Store(spark, str(tmp_path)), [0], Store.commit

    def commit(self, manifest):
        count[0] += 1
        if count[0] - 1 != step:
            return real(self, manifest)
        if when == "half":  # the manifest was cut off
            out = self.fs.create(self._path(f"_log/{manifest['version'] + 1:012}.json"), False)
            out.write(bytearray(b'{"version": 9, "par'))
            out.close()
        elif when == "after":
            real(self, manifest)
        raise Lost

    monkeypatch.setattr(Store, "commit", commit)
    with pytest.raises(Lost):
        life(store, spark)
    life(store, spark)
    assert state(store) == whole
    if when == "before" and step == 1:
        monkeypatch.setattr(Store, "commit", real)
        again = Store(spark, str(tmp_path))
        apply_retention(again, {"radio": RULE}, 11 * DAY, 1 << 60, raw_days=3, hour_days=7)
        assert state(again) == whole and again.sweep() == 0


def test_rows_that_come_again_count_once(spark, tmp_path, whole):
    store = Store(spark, str(tmp_path))
    rows = rows_of(spark, range(0, 80))
    assert deliver(store, "a", {"radio": rows}, t="t") and not deliver(store, "a", {"radio": rows}, t="t")
    deliver(store, "a by another name", {"radio": rows}, t="t")
    days = set(range(10))
    assert compact(store, "radio", RULE, days) > 0
    deliver(store, "and again", {"radio": rows}, t="t")
    deliver(store, "late", {"radio": rows_of(spark, range(80, 90))}, t="t")
    compact(store, "radio", RULE, days)
    assert store.table("hour", "radio").agg(F.sum("n")).first()[0] == 90 and store.table("raw", "radio") is None


def test_days_are_dropped_and_late_hours_stay(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    deliver(store, "a", {"radio": rows_of(spark, [0, 10, 1])}, t="t")
    apply_retention(store, {"radio": RULE}, 100 * DAY, 1 << 60)
    assert store.table("day", "radio").agg(F.sum("n")).first()[0] == 3
    deliver(store, "late", {"radio": rows_of(spark, [80])}, t="t")
    apply_retention(store, {"radio": RULE}, 100 * DAY, 1 << 60)
    assert store.table("day", "radio").agg(F.sum("n")).first()[0] == 3 and store.table("hour", "radio").agg(F.sum("n")).first()[0] == 1
    apply_retention(store, {"radio": RULE}, 900 * DAY, 1 << 60)
    assert store.table("day", "radio") is None and store.table("hour", "radio") is None


def test_erasure_rewrites_only_what_holds_the_device(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    deliver(store, "a", {"radio": rows_of(spark, range(0, 40)), "fixes": rows_of(spark, range(0, 5))}, t="t")
    compact(store, "radio", RULE, {3})
    before = {p["path"] for p in store.parts("raw", "radio")}
    told = erase(store, spark.createDataFrame([("d6",), ("d9",)], "device_id string"))
    left = store.table("raw", "radio")
    assert sorted(r["id"] for r in left.collect()) == [i for i in range(40) if i % 7 != 6 and i % 10 != 3]
    after = {p["path"] for p in store.parts("raw", "radio")}
    assert {t["path"] for t in told if t["action"] == "rewritten"} == before - after and len(before - after) == 4 < len(before)
    assert [t["kind"] for t in told if t["tier"] == "hour"] == ["radio"] and store.table("raw", "fixes").count() == 5
    assert erase(store, spark.createDataFrame([("d6",)], "device_id string")) == [t for t in told if t["tier"] == "hour"]
    index = store.read(store.parts("index", "radio"))
    assert index.where("device_id = 'd6'").count() == 0 and {r["path"] for r in index.collect()} <= after


def test_two_writers_cannot_commit_one_version(spark, tmp_path):
    a, b = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    first, second = a.manifest(), b.manifest()
    a.commit(first)
    with pytest.raises(Exception, match="exists"):
        b.commit(second)
    assert lifecycle.Store(spark, str(tmp_path)).manifest()["version"] == 1
