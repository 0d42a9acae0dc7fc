"""Studies: ping-pong returns matched with controls, transfer pairs, cold and warm probes, masts and areas by hour.

The two greedy rules that depend on order (which return closes which departure; which control a case takes) run along the
rows of a device and subscription and hold a reach of rows, or counts; all before and after is on columns.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percentiles, weighted_hist, wilson
from .intervals import _islands
from .ordered import in_order

PING_PONG_MS, TOLERANCE = 30000, 2  # fixed values


def returns_of(times: list[int], origins: list, targets: list, reach: int = PING_PONG_MS) -> tuple[list[bool], list[bool]]:
    """Of changes in order: which take part in a ping-pong, and which are a return. A departure is closed by the first
    later change within reach that goes back to its origin; a return closes no other departure of its own."""
    part, back = [False] * len(times), [False] * len(times)
    for i in range(len(times)):
        if back[i]:
            continue
        for j in range(i + 1, len(times)):
            if times[j] - times[i] > reach:
                break
            if targets[j] == origins[i]:
                part[i] = part[j] = back[j] = True
                break
    return part, back


def _returns_along(t: int, origin: int, target: int, reach: int = PING_PONG_MS):
    """``returns_of`` for rows that pass by, with the places of their columns: holds the rows of one reach."""
    def rule(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: deque[list] = deque()  # row, part, back
        waiting: dict = {}  # origin: departures that no row has closed
        for row in rows:
            while held and row[t] - held[0][0][t] > reach:
                old = held.popleft()
                own = waiting.get(old[0][origin], [])
                if own and own[0] is old:
                    own.pop(0)
                    if not own:
                        del waiting[old[0][origin]]
                yield (*old[0], old[1], old[2])
            closed = waiting.pop(row[target], [])
            now = [row, bool(closed), bool(closed)]
            for other in closed:
                other[1] = True
            if not closed:
                waiting.setdefault(row[origin], []).append(now)
            held.append(now)
        yield from ((*r, part, back) for r, part, back in held)

    return rule


def mark_pingpong(changes: DataFrame, keys: list[str], t: str, origin: str, target: str, order: list[str]) -> DataFrame:
    """Adds ``pingpong`` and ``is_return`` to changes. Gaps above the reach part the changes of a key."""
    before = F.lag(t).over(Window.partitionBy(*keys).orderBy(*order))
    rows = _islands(changes, keys, order, F.coalesce(F.col(t) - before > PING_PONG_MS, F.lit(True)))
    schema = rows.withColumn("pingpong", F.lit(True)).withColumn("is_return", F.lit(True)).schema
    return in_order(rows, [*keys, "_island"], order, schema, _returns_along(*(rows.columns.index(c) for c in (t, origin, target)))).drop("_island")


def greedy_pairs(cases: list[tuple[int, int]], controls: list[tuple[int, int]], tolerance: int = TOLERANCE) -> list[tuple[int, int]]:
    """(case id, control id) for cases and controls (id, level) in order: each case takes the first free control of its
    level, else of the levels 1 below, 1 above, and so on."""
    pool: dict[int, list[int]] = {}
    for i, level in reversed(controls):
        pool.setdefault(level, []).append(i)
    out = []
    for i, level in cases:
        for d in sorted(range(-tolerance, tolerance + 1), key=lambda d: (abs(d), d)):
            if pool.get(level + d):
                out.append((i, pool[level + d].pop()))
                break
    return out


def _pairs_along(n_keys: int, tolerance: int = TOLERANCE):
    """``greedy_pairs`` by counts: of rows (keys, level, controls of the level, id, ...), levels first, then the cases in
    order; gives (keys, case_id, level, rank) of the control to take."""
    def rule(rows: Iterator[tuple]) -> Iterator[tuple]:
        free: dict[int, int] = {}
        taken: dict[int, int] = {}
        steps = sorted(range(-tolerance, tolerance + 1), key=lambda d: (abs(d), d))
        for row in rows:
            level, controls, id_ = row[n_keys : n_keys + 3]
            if controls is not None:
                free[level] = controls
                continue
            for at in (level + d for d in steps):
                if taken.get(at, 0) < free.get(at, 0):
                    taken[at] = taken.get(at, 0) + 1
                    yield (*row[:n_keys], id_, at, taken[at])
                    break

    return rule


def match_controls(rows: DataFrame, keys: list[str], id_: str, level: str, case: str, order: list[str]) -> DataFrame:
    """(keys, case_id, control_id) within each key: cases matched with controls without replacement, in order. A case takes
    a rank of a level, so only counts are held; the controls are joined by their ranks."""
    rows = rows.withColumn("_level", F.col(level).cast("long"))
    controls = rows.where(~F.col(case))
    counts = controls.groupBy(*keys, "_level").agg(F.count("*").alias("_controls")).select(*keys, "_level", "_controls", F.lit(None).cast(rows.schema[id_].dataType).alias("case_id"), *[F.lit(None).cast(rows.schema[o].dataType).alias(f"_o{k}") for k, o in enumerate(order)])
    cases = rows.where(F.col(case)).select(*keys, "_level", F.lit(None).cast("long").alias("_controls"), F.col(id_).alias("case_id"), *[F.col(o).alias(f"_o{k}") for k, o in enumerate(order)])
    both = counts.union(cases).withColumn("_side", F.col("_controls").isNull().cast("int"))
    schema = both.select(*keys, "case_id", "_level", F.lit(0).cast("long").alias("_rank")).schema
    took = in_order(both, keys, ["_side", *(f"_o{k}" for k in range(len(order)))], schema, _pairs_along(len(keys)))
    ranks = F.row_number().over(Window.partitionBy(*keys, "_level").orderBy(*order)).cast("long")
    return took.join(controls.select(*keys, "_level", ranks.alias("_rank"), F.col(id_).alias("control_id")), [*keys, "_level", "_rank"]).select(*keys, "case_id", "control_id")


def pair_transfers(rows: DataFrame, keys: list[str], t: str, direction: str, order: list[str], gap: int = 60000) -> DataFrame:
    """(keys, first_id, second_id): neighbouring rows of opposite directions at most ``gap`` apart, each used once. Along a
    run in which every row could pair with the next, the first pairs with the second, the third with the fourth."""
    by = Window.partitionBy(*keys).orderBy(*order)
    linked = F.coalesce((F.lag(direction).over(by) != F.col(direction)) & (F.col(t) - F.lag(t).over(by) <= gap), F.lit(False))
    runs = rows.withColumn("_new", (~linked).cast("int")).withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inner = Window.partitionBy(*keys, "_run").orderBy(*order)
    seen = runs.withColumn("_k", F.row_number().over(inner)).withColumn("second_id", F.lead("id").over(inner))
    return seen.where("_k % 2 = 1 and second_id is not null").select(*keys, F.col("id").alias("first_id"), "second_id")


def site_hours(radio: DataFrame, keys: list[str], hour: Column) -> DataFrame:
    """(keys, hour, samples, below, last_day) of rows with a mast: samples with a sinr, and those below 0 dB."""
    rows = radio.where("sinr is not null").withColumn("hour", hour)
    return rows.groupBy(*keys, "hour").agg(F.count("*").alias("samples"), F.count_if(F.col("sinr") < 0).alias("below"), F.max(F.floor(F.col("wall_ms") / 86400000)).alias("last_day"))


def circular_verdict(hours: DataFrame, keys: list[str], reach: int = 2, least: int = 80, bad: float = 0.25) -> DataFrame:
    """(keys, hour, samples, share, verdict) over the hours within ``reach`` around each, the day taken as a circle."""
    spread = hours.withColumn("hour", F.explode(F.transform(F.sequence(F.lit(-reach), F.lit(reach)), lambda d: F.pmod(F.col("hour") + d, F.lit(24)))))
    out = spread.groupBy(*keys, "hour").agg(F.sum("samples").alias("samples"), F.sum("below").alias("below"))
    share = F.col("below") / F.col("samples")
    return out.select(*keys, "hour", "samples", share.alias("share"), F.when(F.col("samples") < least, "unknown").when(share >= bad, "bad").otherwise("good").alias("verdict"))


def best_part(hours: DataFrame, keys: list[str], least: int = 80, bad: float = 0.25) -> DataFrame:
    """(keys, part, share): the part of the day with the least share below, if it is good enough to say so (below half of
    ``bad``); parts with fewer than ``least`` samples don't count."""
    h = F.col("hour")
    part = F.when(h <= 6, "overnight").when(h <= 11, "morning").when(h <= 17, "afternoon").otherwise("evening")
    parts = hours.groupBy(*keys, part.alias("part")).agg(F.sum("samples").alias("_n"), F.sum("below").alias("_b")).where(F.col("_n") >= least)
    best = parts.groupBy(*keys).agg(F.min(F.struct((F.col("_b") / F.col("_n")).alias("share"), "part")).alias("x"))
    return best.select(*keys, "x.part", "x.share").where(F.col("share") < bad / 2)


def lookahead(points: DataFrame, hours: DataFrame, cell: str, neighbours: Column, least: int, bad: float) -> DataFrame:
    """Adds bad_here and bad_ahead to points (cell, hour): whether their cell is bad then, or it is not and a neighbour is."""
    known = hours.where(F.col("samples") >= least).select(F.col(cell).alias("_c"), F.col("hour").alias("_h"), (F.col("below") / F.col("samples") >= bad).alias("_bad"))
    keys = points.select(cell, "hour").distinct()
    around = keys.select(cell, "hour", F.explode(F.array_append(neighbours, F.col(cell))).alias("_c"))
    met = around.join(known, (around["_c"] == known["_c"]) & (around["hour"] == known["_h"])).select(around[cell], around["hour"], (around["_c"] == around[cell]).alias("_own"), "_bad")
    told = met.groupBy(cell, "hour").agg(F.coalesce(F.bool_or(F.col("_own") & F.col("_bad")), F.lit(False)).alias("bad_here"), F.coalesce(F.bool_or(~F.col("_own") & F.col("_bad")), F.lit(False)).alias("bad_ahead"))
    out = points.join(told, [cell, "hour"], "left").withColumns({c: F.coalesce(F.col(c), F.lit(False)) for c in ("bad_here", "bad_ahead")})
    return out.withColumn("bad_ahead", F.col("bad_ahead") & ~F.col("bad_here"))


def asymmetry(pairs: DataFrame, rows: DataFrame, least: int = 10) -> DataFrame:
    """One row: pairs of a download and an upload, those complete, failed legs of each, how often the download led, the median
    times, the geometric ratio of the times (upload to download) with its interval, and the verdict, or the gate that forbids
    one: too few complete pairs, over a quarter as many failed legs as pairs, one direction leading too often, no interval,
    or one that spans more than ten times."""
    leg = lambda p: rows.select(F.col("id").alias(f"{p}_id"), F.col("direction").alias(f"{p}_d"), F.col("latency_ms").alias(f"{p}_ms"), F.col("outcome").alias(f"{p}_o"))
    both = pairs.join(leg("first"), "first_id").join(leg("second"), "second_id")
    first = F.col("first_d") == "DOWN"
    of = lambda c, down: F.when(first == F.lit(down), F.col(f"first_{c}")).otherwise(F.col(f"second_{c}"))
    whole = (F.col("first_o") == "OK") & (F.col("second_o") == "OK") & (F.col("first_ms") > 0) & (F.col("second_ms") > 0)
    both = both.select(first.alias("_led"), of("ms", True).alias("down"), of("ms", False).alias("up"), (of("o", True) != "OK").alias("_df"), (of("o", False) != "OK").alias("_uf"), whole.alias("_whole"))
    log = F.when(F.col("_whole"), F.ln(F.col("up").cast("double") / F.col("down")))
    g = both.agg(F.count("*").alias("pairs"), F.count_if("_whole").alias("complete"), F.count_if("_uf").alias("up_failed"), F.count_if("_df").alias("down_failed"), F.count_if("_led").alias("down_first"), F.avg(log).alias("m"), F.stddev_samp(log).alias("s"))
    times = both.where("_whole").select(F.explode(F.array(F.struct(F.lit("down").alias("leg"), F.col("down").alias("ms")), F.struct(F.lit("up").alias("leg"), F.col("up").alias("ms")))).alias("x")).select("x.*")
    median = percentiles(weighted_hist(times, ["leg"], "ms"), ["leg"], "ms", "E", ms=0.5)
    median = median.agg(F.max(F.when(F.col("leg") == "down", F.col("ms"))).alias("down_ms"), F.max(F.when(F.col("leg") == "up", F.col("ms"))).alias("up_ms"))
    half = F.col("s") * 1.96 / F.sqrt(F.col("complete"))
    g = g.crossJoin(F.broadcast(median)).withColumns({"ratio": F.exp("m"), "lo": F.exp(F.col("m") - half), "hi": F.exp(F.col("m") + half)})  # one row joined on
    n, share = F.col("pairs"), F.try_divide("down_first", "pairs")
    gate = F.when(F.col("complete") < least, "too few").when(F.col("up_failed") + F.col("down_failed") > F.floor(n / 4), "incomplete").when((share < 0.3) | (share > 0.7), "confounded").when(F.col("lo").isNull(), "no interval").when(F.col("hi") / F.col("lo") > 10, "too variable")
    gate = gate.when(F.col("lo") > 1, "uplink slower").when(F.col("hi") < 1, "downlink slower").otherwise("no asymmetry")
    return g.select("pairs", "complete", "up_failed", "down_failed", "down_first", "down_ms", "up_ms", "ratio", "lo", "hi", gate.alias("gate"))


def site_status(hours: DataFrame, keys: list[str], radio: DataFrame, mark: int, t: str = "wall_ms") -> DataFrame:
    """One row on the record of masts (keys, hour, samples): masts, slots, samples, and the radio rows behind the mark."""
    behind = radio.where(F.col(t) > mark).agg(F.count("*").alias("behind"))
    return hours.agg(F.countDistinct(*keys).alias("masts"), F.count("*").alias("slots"), F.coalesce(F.sum("samples"), F.lit(0)).alias("samples")).crossJoin(F.broadcast(behind))  # one row joined on


def handover_outcomes(changes: DataFrame, failures: DataFrame, keys: list[str], sub: str) -> DataFrame:
    """Adds ``outcome`` to changes (before, ci): ping-pong if a later change within 30 s goes back, else failed with a failure
    from 4 s before to 6 s after, else clean."""
    from .intervals import bucketed_range_join

    spans = changes.select("id", *keys, (F.col("wall_ms") - 4000).alias("lo"), (F.col("wall_ms") + 6000).alias("hi"))
    failed = bucketed_range_join(failures, spans, keys, "wall_ms", "lo", "hi", 20000).select(F.col("id").alias("_failed")).distinct()
    # the next change that goes to a cell, of those that come back to it: an equality join on the cell and time buckets
    ahead = changes.select(F.col("id").alias("_id"), F.col("wall_ms").alias("_t"), *keys, sub, F.col("before").alias("_cell"), F.col("wall_ms").alias("lo"), (F.col("wall_ms") + PING_PONG_MS).alias("hi"))
    to = changes.select("id", "wall_ms", *keys, sub, F.col("ci").alias("_cell"))
    met = bucketed_range_join(to, ahead, [*keys, sub, "_cell"], "wall_ms", "lo", "hi", 60000)
    back = met.where((F.col("wall_ms") > F.col("_t")) | (F.col("id") > F.col("_id"))).select(F.col("_id").alias("_back")).distinct()
    out = changes.join(failed, F.col("id") == F.col("_failed"), "left").join(back, F.col("id") == F.col("_back"), "left")
    return out.withColumn("outcome", F.when(F.col("_back").isNotNull(), "ping-pong").when(F.col("_failed").isNotNull(), "failed").otherwise("clean")).drop("_failed", "_back")


def _near_failures(changes: DataFrame, failures: DataFrame, keys: list[str]) -> DataFrame:
    """(id, _f) of changes with a failure from 36 s before to 6 s after."""
    from .intervals import bucketed_range_join

    spans = changes.select("id", *keys, (F.col("wall_ms") - 36000).alias("lo"), (F.col("wall_ms") + 6000).alias("hi"))
    return bucketed_range_join(failures, spans, keys, "wall_ms", "lo", "hi", 60000).select("id", F.lit(1).alias("_f")).distinct()


def case_control(pairs: DataFrame, changes: DataFrame, failures: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """(arm, n, failed, share, lo, hi, valid) of cases and controls: those with a failure from 36 s before to 6 s after."""
    failed = _near_failures(changes, failures, keys)
    arms = pairs.select(F.lit("case").alias("arm"), F.col("case_id").alias("id")).union(pairs.select(F.lit("control"), "control_id"))
    g = arms.join(failed, "id", "left").groupBy("arm").agg(F.count("*").alias("n"), F.count("_f").alias("failed"))
    share = F.col("failed") / F.col("n")
    ci = wilson(share, F.col("n"))
    return g.select("arm", "n", "failed", share.alias("share"), ci["lo"].alias("lo"), ci["hi"].alias("hi"), (F.col("n") >= least).alias("valid"))


def verdicts(pairs: DataFrame, changes: DataFrame, failures: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """(label, pairs, case_failed, control_failed, case_churn, control_churn, verdict) over all pairs and over those whose case is of
    one kind, sector or mast. Fewer than ``least`` pairs, or no failure in either arm, are invalid; else the arms differ if
    their intervals are apart. The churns are medians."""
    failed = _near_failures(changes, failures, keys)
    both = pairs.select("case_id", "control_id").join(changes.select(F.col("id").alias("case_id"), "kind", F.col("churn").alias("case")), "case_id").join(changes.select(F.col("id").alias("control_id"), F.col("churn").alias("control")), "control_id")
    for arm in ("case", "control"):
        both = both.join(failed.select(F.col("id").alias(f"{arm}_id"), F.col("_f").alias(f"_{arm}")), f"{arm}_id", "left")
    rows = both.withColumn("label", F.explode(F.array(F.lit("overall"), "kind"))).where("label in ('overall', 'sector', 'mast')")
    g = rows.groupBy("label").agg(F.count("*").alias("pairs"), F.count("_case").alias("case_failed"), F.count("_control").alias("control_failed"))
    for arm in ("case", "control"):
        g = g.join(percentiles(weighted_hist(rows, ["label"], arm), ["label"], arm, "E", **{f"{arm}_churn": 0.5}), "label")
    a, b = (wilson(F.col(f"{arm}_failed") / F.col("pairs"), F.col("pairs")) for arm in ("case", "control"))
    invalid = (F.col("pairs") < least) | (F.col("case_failed") + F.col("control_failed") == 0)
    return g.withColumn("verdict", F.when(invalid, "invalid").when(a["lo"] > b["hi"], "harmful").when(a["hi"] < b["lo"], "protective").otherwise("no association"))


def outcome_study(pairs: DataFrame, changes: DataFrame, outcomes: DataFrame, coverage: DataFrame, device: str = "device_id", sub: str = "sub_id", least: int = 20, blind: float = 0.30) -> DataFrame:
    """The whole study over matched pairs: (label, pairs, per arm the windows with a failed probe, a lost route, a drop of service, any
    of these, and the p50 and p90 of the latencies that succeeded, the median churns, invalid, verdict), overall and for cases of
    one kind, sector or mast.

    ``changes``: id, device, sub, wall_ms, kind, churn, is_return; ``outcomes``: device, sub, wall_ms, what (probe, route, service or
    ok), latency_ms; one join of all within 36 s before to 6 s after a change, services only of the change's own subscription.
    ``coverage``: one row (fresh_ms, span_ms). Invalid, in order: no fresh readings, too little coverage, too few returns, no pairs,
    too few pairs of the label, no harm in either arm; then there is no verdict but that.
    """
    from .intervals import bucketed_range_join

    spans = changes.select("id", device, F.col(sub).alias("_sub"), (F.col("wall_ms") - 36000).alias("lo"), (F.col("wall_ms") + 6000).alias("hi"))
    met = bucketed_range_join(outcomes, spans, [device], "wall_ms", "lo", "hi", 60000).where((F.col("what") != "service") | (F.col(sub) == F.col("_sub")))
    harms = ("probe", "route", "service")
    flags = met.where("what <> 'ok'").groupBy("id").agg(*[F.max((F.col("what") == h).cast("int")).alias(h) for h in harms])
    kinds = changes.select(F.col("id").alias("case_id"), "kind")
    labels = F.explode(F.array(F.lit("overall"), F.col("kind"))).alias("label")
    arms = pairs.join(kinds, "case_id").select(labels, F.inline(F.array(F.struct(F.lit("case").alias("arm"), F.col("case_id").alias("id")), F.struct(F.lit("control").alias("arm"), F.col("control_id").alias("id"))))).where("label in ('overall', 'sector', 'mast')")
    rows = arms.join(changes.select("id", "churn"), "id").join(flags, "id", "left").fillna(0, list(harms)).withColumn("any", F.greatest(*harms))
    by = ["label", "arm"]
    tally = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(h).alias(h) for h in (*harms, "any")])
    waits = arms.join(met.where("what = 'ok'").select("id", "latency_ms"), "id")
    tally = tally.join(percentiles(weighted_hist(waits, by, "latency_ms"), by, "latency_ms", "C", p50_ms=0.5, p90_ms=0.9), by, "left").join(percentiles(weighted_hist(rows, by, "churn"), by, "churn", "E", churn=0.5), by, "left")
    names = [*harms, "any", "p50_ms", "p90_ms", "churn"]
    every = changes.sparkSession.createDataFrame([("overall",), ("sector",), ("mast",)], "label string")
    wide = tally.groupBy("label").agg(F.max("n").alias("pairs"), *[F.max(F.when(F.col("arm") == arm, F.col(c))).alias(f"{arm}_{c}") for arm in ("case", "control") for c in names])
    out = every.join(wide, "label", "left").withColumn("pairs", F.coalesce("pairs", F.lit(0).cast("long")))
    known = coverage.crossJoin(changes.agg(F.count_if("is_return").alias("_returns"))).crossJoin(pairs.agg(F.count("*").alias("_all")))  # one row each
    out = out.crossJoin(F.broadcast(known))
    share = F.when(F.col("span_ms") > 0, F.col("fresh_ms") / F.col("span_ms"))
    harm = F.coalesce(F.col("case_any") + F.col("control_any"), F.lit(0))
    invalid = F.when(F.coalesce("fresh_ms", F.lit(0)) == 0, "no fresh readings").when(F.coalesce(share, F.lit(0.0)) < blind, "coverage").when(F.col("_returns") < least, "few returns").when(F.col("_all") == 0, "no matches").when(F.col("pairs") < least, "few pairs").when(harm == 0, "no harm")
    a, b = (wilson(F.col(f"{arm}_any") / F.col("pairs"), F.col("pairs")) for arm in ("case", "control"))
    verdict = F.when(invalid.isNotNull(), "invalid").when(a["lo"] > b["hi"], "harmful").when(a["hi"] < b["lo"], "protective").otherwise("no association")
    return out.select("label", "pairs", *[f"{arm}_{c}" for arm in ("case", "control") for c in names], invalid.alias("invalid"), verdict.alias("verdict"))
