"""Each registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from netfathom.operators import devices as courses
from netfathom.operators import studies
from netfathom.plans import core, coverage, devices, incidents, maps, more, signals  # noqa: F401
from netfathom.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def rows(found, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    tidy = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted(columns), sorted((tuple(tidy(r[i]) for i in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    want = db.sql(SQL[name])
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), list(want.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_the_map_takes_probes_and_flaps(spark):
    whole = {r["cell"]: r for r in QUERIES["coverage_map"](spark, SF).collect()}
    radio = {r["cell"]: r for r in QUERIES["classify_bins"](spark, SF).collect()}
    assert set(whole) == set(radio) and all(sum(r[c] for r in whole.values()) > 0 for c in ("flaps", "probe_n", "probe_fail", "cold_n", "cold_fail", "ok_n"))
    assert any(radio[k]["outcome"] == "LTE" and r["outcome"] in ("ROUTE_LOSS", "SLOW") for k, r in whole.items())


def groups(rows, keys, order):
    found = {}
    for r in sorted(rows, key=lambda r: tuple(r[o] for o in order)):
        found.setdefault(tuple(r[k] for k in keys), []).append(r)
    return found


def column(rows, name):
    return [r[name] for r in rows]


def hot(spark, n=6000):
    """Changes of which one key holds most, with ties, dense stretches and gaps."""
    rows = [(0 if i % 3 else i % 5, i % 2, i, i * 400 // 7 * 7 + i // 1000 * 50000, i * 7 % 4, i * 11 % 5) for i in range(n)]
    return spark.createDataFrame(rows, "device_id long, sub_id int, id long, wall_ms long, before long, ci long")


@pytest.mark.parametrize("data", ["table", "hot"])
def test_studies_equal_their_rules(spark, data):
    keys, order = ["device_id", "sub_id"], ["wall_ms", "id"]
    table = core._cell_changes(spark, SF) if data == "table" else hot(spark)
    changes = coverage.intervals.local_count(table, keys, "wall_ms", 3000, "churn")
    marked = studies.mark_pingpong(changes, keys, "wall_ms", "before", "ci", order)
    rows, want = marked.collect(), {}
    for own in groups(changes.collect(), keys, order).values():
        want |= {r["id"]: x for r, *x in zip(own, *studies.returns_of(*(column(own, c) for c in ("wall_ms", "before", "ci"))))}
    assert len(rows) == len(want) and {r["id"]: [r["pingpong"], r["is_return"]] for r in rows} == want
    pairs = studies.match_controls(marked.where("not is_return"), keys, "id", "churn", "pingpong", order).collect()
    want = set()
    for k, own in groups([r for r in rows if not r["is_return"]], keys, order).items():
        want |= {(*k, *p) for p in studies.greedy_pairs(*([(r["id"], r["churn"]) for r in own if r["pingpong"] == case] for case in (True, False)))}
    assert len(pairs) == len(want) and set(map(tuple, pairs)) == want and (want or data == "table")


def test_courses_equal_their_rules(spark):
    rows = hot(spark).selectExpr("device_id", "id", "wall_ms", "ci div 3 as cell", "id % 900 < 500 as bad")
    own = groups(rows.collect(), ["device_id"], ["wall_ms", "id"]).values()
    limits = {"window": 20000, "least": 5, "dwell": 30000}
    states = {r["id"]: r["poor"] for r in courses.area_state(rows, ["device_id"], "wall_ms", "bad", ["wall_ms", "id"], **limits).collect()}
    assert states == {r["id"]: x for g in own for r, x in zip(g, courses.area_states(column(g, "wall_ms"), column(g, "bad"), **limits))} and len(set(states.values())) == 2
    kept = [r["id"] for r in courses.thin(rows, ["device_id"], "wall_ms", "cell", ["wall_ms", "id"], 1500).collect()]
    assert sorted(kept) == sorted(r["id"] for g in own for r, x in zip(g, courses.kept_times(column(g, "wall_ms"), column(g, "cell"), 1500)) if x)


def test_a_key_is_not_gathered():
    held = []

    def rows():
        for i in range(50000):
            held.append(i)
            yield 1, i * 1000, i % 3, (i + 1) % 3

    first = next(iter(studies._returns_along(1, 2, 3)(rows())))
    assert first == (1, 0, 0, 1, True, False) and len(held) < 40


def test_names_have_precedence(spark):
    kinds = {r["network_name"].split(" ")[0].split("#")[0] for r in QUERIES["network_names"](spark, SF).collect()}
    assert {"curated", "learned", "Customer"} <= kinds
