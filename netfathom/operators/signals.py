"""Rules on readings and reports: quality flags, normalised signals, probe kinds, names, carriers, neighbours, sky, holds.

Null in, null out, unless said otherwise. Ties are broken by the order columns, or by the least value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.radio import normalise_error
from .intervals import _islands
from .ordered import in_order
from .devices import _kept_along

# fixed values
UNAVAILABLE = 2147483647
STALE_CELL_MS = 120000
#: Bits of the quality flags, in order: what holds for each.
FLAGS = [
    "rsrp IN (-140, -43)", "rsrq IN (-34, 3)", "rssnr IN (-20, 30)", "ta NOT BETWEEN 0 AND 1282", "cqi NOT BETWEEN 0 AND 15", "(ci IS NOT NULL OR pci IS NOT NULL) AND cell_age_ms > 120000",
    "coalesce(ss_rsrp IN (-140, -44), false) OR coalesce(ss_rsrq IN (-43, 20), false) OR coalesce(ss_sinr IN (-23, 40), false)", "band_ambiguous", "band_reported <> band_derived", "withheld",
]
CN0_BLOCKED, CN0_OPEN, USED_BLOCKED, USED_OPEN = 28.0, 40.0, 5.0, 16.0
KEEPALIVE_MS, DORMANCY_MS = 5000, 10000


def flags_sql() -> str:
    return " + ".join(f"CASE WHEN {c} THEN {1 << k} ELSE 0 END" for k, c in enumerate(FLAGS))


def quality_flags(df: DataFrame) -> DataFrame:
    """Adds ``flags``: a bit for each reading that sits on a clamp of its scale or outside of it, for an old cell identity, for a
    band that is ambiguous or unlike the reported one, and for a withheld identity. A flagged row stays."""
    return df.withColumn("flags", F.expr(flags_sql()).cast("int"))


def normalise_signal(df: DataFrame, lte: dict[str, str], nr: dict[str, str]) -> DataFrame:
    """Readings that are unavailable become null. Adds ``live_<name>``, the LTE reading (``lte``: name to column), else that of
    NR, and ``nr_present``, whether any NR reading is there."""
    own = [*lte.values(), *nr.values()]
    out = df.withColumns({c: F.nullif(F.col(c), F.lit(UNAVAILABLE)) for c in own})
    live = {f"live_{n}": F.coalesce(F.col(c), F.col(nr[n])) if n in nr else F.col(c) for n, c in lte.items()}
    return out.withColumns(live).withColumn("nr_present", reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in nr.values()]))


def probe_kind(probe_type: Column, error: Column) -> Column:
    """What a probe row is: of the instrument, without a bearer, a recovery summary, a transfer, a test of reachability."""
    starts = lambda *names: reduce(lambda a, b: a | b, [probe_type.startswith(n) for n in names])
    by_type = F.when(starts("BINDFAIL"), "INSTRUMENT").when(starts("NOBEARER"), "NO_BEARER").when(starts("STALL"), "RECOVERY").when(starts("UP", "DOWN"), "TRANSFER").when(starts("TLS", "TCP", "DNS"), "REACHABILITY").otherwise("UNKNOWN")
    return F.when(error.contains("Binding socket"), "INSTRUMENT").when(error.contains("no cellular network"), "NO_BEARER").otherwise(by_type)


def excluded_from_rates(kind: Column) -> Column:
    return kind.isin("INSTRUMENT", "RECOVERY", "NO_BEARER")


def probe_tallies(probes: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per key of probes (kind, on_bearer, outcome, error, cold): recoveries are no samples of a place; those of the
    instrument and those without a bearer are counted apart. ``top_error``: the most frequent reason of failures."""
    none = F.col("kind") == "NO_BEARER"
    counted = ~F.col("kind").isin("INSTRUMENT", "RECOVERY", "NO_BEARER") & F.col("on_bearer")
    fail = F.col("outcome") != "OK"
    out = probes.groupBy(*keys).agg(
        F.count_if(counted).alias("probe_n"), F.count_if(counted & fail).alias("probe_fail"), F.count_if(F.col("kind") == "INSTRUMENT").alias("instrument_n"),
        F.count_if(none | ~F.col("kind").isin("INSTRUMENT", "RECOVERY") & ~F.col("on_bearer")).alias("no_bearer_n"), F.count_if(counted & F.col("cold")).alias("cold_n"), F.count_if(counted & F.col("cold") & fail).alias("cold_fail"),
    )
    errors = probes.where(counted & fail).groupBy(*keys, normalise_error(F.col("error")).alias("_e")).agg(F.count("*").alias("_n"))
    top = errors.groupBy(*keys).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_e").alias("e"))).alias("_t"))
    return out.join(top.select(*keys, F.col("_t.e").alias("top_error"), (-F.col("_t.n")).alias("top_error_n")), keys, "left")


def learn_names(reports: DataFrame, order: list[str], curated: DataFrame) -> DataFrame:
    """(plmn, name): the last learnable name reported of each network. Learnable: the code has a hyphen; the name has 1 to 32
    characters, is not made of digits, is not the code, and is not the SIM's own name on another network than its own; networks
    with a curated name (plmn) learn none. ``reports``: plmn, reported, sim_plmn, sim_name."""
    norm = lambda c: F.regexp_replace(c, r"-0+(?=[^-])", "-")
    p, n = F.trim(F.coalesce("plmn", F.lit(""))), F.trim(F.coalesce("reported", F.lit("")))
    rows = reports.withColumn("_p", p).withColumn("_n", n).withColumn("_key", norm(F.col("_p")))
    borrowed = F.coalesce((F.lower("_n") == F.lower(F.trim("sim_name"))) & (norm(F.trim("sim_plmn")) != F.col("_key")), F.lit(False))
    usable = F.col("_p").contains("-") & F.col("_n").rlike("^.{1,32}$") & ~F.col("_n").rlike("^[0-9 -]+$") & (F.lower("_n") != F.lower("_p")) & ~borrowed
    told = rows.where(usable).groupBy("_key").agg(F.max_by("_n", F.struct(*order)).alias("name")).select(F.col("_key").alias("plmn"), "name")
    return told.join(curated.select(norm(F.col("plmn")).alias("plmn")).distinct(), "plmn", "left_anti")


def effective_band(df: DataFrame) -> DataFrame:
    """Adds band_used and band_rat: the stored band with its technology, else the derived one with its own, else the raw band
    with none."""
    rat = F.when(F.col("stored_band").isNotNull(), F.col("stored_rat")).when(F.col("derived_band").isNotNull(), F.col("derived_rat"))
    return df.withColumn("band_used", F.coalesce("stored_band", "derived_band", "raw_band")).withColumn("band_rat", rat)


def top_neighbours(cells: DataFrame, keys: list[str], t: str, serving: str, k: int = 6, every: int = 60000) -> DataFrame:
    """The strongest ``k`` neighbours of each report that is written: one each ``every``, and at once where the serving cell
    changed. Secondary carriers are no neighbours, nor are registered cells but for NR ones beside a serving cell that is not
    NR. ``cells``: keys, t, serving, serving_rat, rat, pci, rsrp, secondary, registered."""
    reports = cells.select(*keys, t, F.coalesce(serving, F.lit(-1)).alias("_s")).distinct()
    by = Window.partitionBy(*keys).orderBy(t)
    runs = _islands(reports.withColumn("_edge", F.lit(False)), keys, [t], F.coalesce(F.lag("_s").over(by) != F.col("_s"), F.lit(True)))
    kept = in_order(runs, [*keys, "_island"], [t], runs.schema, _kept_along(runs.columns.index(t), runs.columns.index("_edge"), every)).select(*keys, t)
    own = cells.where(~F.col("secondary") & (~F.col("registered") | (F.col("rat") == "NR") & (F.col("serving_rat") != "NR"))).join(kept, [*keys, t])
    place = F.row_number().over(Window.partitionBy(*keys, t).orderBy(F.desc_nulls_last("rsrp"), "pci"))
    return own.withColumn("place", place).where(F.col("place") <= k)


def carrier_aggregation(reports: DataFrame, keys: list[str], t: str, as_of: int, max_age: int = 270000) -> DataFrame:
    """(keys, tier, carriers, aggregated, disagree): of the latest report of each tier (0 bandwidths, 1 and 2 with roles; n
    carriers) the newer one with roles that has any and is not stale, else the bandwidths, else nothing is known. Disagree:
    the bandwidths tell another number."""
    last = reports.groupBy(*keys, "tier").agg(F.max_by("n", F.struct(t, "id")).alias("n"), F.max(t).alias("at"))
    roles = (F.col("tier") > 0) & (F.col("n") > 0) & (F.lit(as_of) - F.col("at") <= max_age)
    out = last.groupBy(*keys).agg(F.max(F.when(roles, F.struct("at", "tier", "n"))).alias("_r"), F.max(F.when(F.col("tier") == 0, F.col("n"))).alias("_w"))
    tier = F.when(F.col("_r").isNotNull(), F.col("_r.tier")).when(F.col("_w") > 0, 0)
    n = F.when(F.col("_r").isNotNull(), F.col("_r.n")).when(F.col("_w") > 0, F.col("_w")).otherwise(0)
    return out.select(*keys, tier.alias("tier"), n.alias("carriers"), F.when(tier.isNotNull(), n > 1).alias("aggregated"), F.coalesce(F.col("_r").isNotNull() & (F.col("_w") > 0) & (F.col("_w") != F.col("_r.n")), F.lit(False)).alias("disagree"))


def majority_map(pairs: DataFrame, slots: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the value most often seen with each key, ties to the least; keys never seen take that of ``slots``."""
    often = pairs.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("_n"))
    best = often.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_b")).select(key, F.col("_b.v").alias("_v"))
    return best.join(slots.select(key, F.col(value).alias("_s")), key, "full_outer").select(key, F.coalesce("_v", "_s").alias(value))


def instrument_health(probes: DataFrame, checks: DataFrame, keys: list[str], as_of: int, window: int = 1200000, share: float = 0.25) -> DataFrame:
    """(keys, tests, instrument_n, no_bearer_n, probe_level, worst): the state of the instrument by the probes (kind) of the last
    ``window`` and the latest level of each other check (check, level). Probes that could not start are no tests of the
    network; above ``share`` of the tests the instrument is broken."""
    rank = {"UNKNOWN": 0, "OK": 1, "DEGRADED": 2, "BROKEN": 3}
    levels = lambda c: reduce(lambda out, kv: F.when(c == kv[0], kv[1]).otherwise(out), rank.items(), F.lit(0))
    recent = F.col("wall_ms") > as_of - window
    p = probes.groupBy(*keys).agg(F.count_if(recent).alias("_n"), F.count_if(recent & (F.col("kind") == "INSTRUMENT")).alias("instrument_n"), F.count_if(recent & (F.col("kind") == "NO_BEARER")).alias("no_bearer_n"))
    last = checks.groupBy(*keys, "check").agg(F.max_by("level", F.struct("wall_ms", "id")).alias("level")).groupBy(*keys).agg(F.max(levels(F.col("level"))).alias("_worst"))
    both = p.join(last, keys, "full_outer").withColumn("tests", F.coalesce(F.col("_n") - F.col("no_bearer_n"), F.lit(0))).withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("instrument_n", "no_bearer_n")})
    level = F.when((F.col("tests") > 0) & (F.col("instrument_n") > share * F.col("tests")), "BROKEN").when((F.col("tests") <= 0) & (F.col("no_bearer_n") > 0), "DEGRADED").when(F.coalesce("_n", F.lit(0)) == 0, "UNKNOWN").otherwise("OK")
    worst = F.greatest(levels(level), F.coalesce("_worst", F.lit(0)))
    return both.select(*keys, "tests", "instrument_n", "no_bearer_n", level.alias("probe_level"), F.element_at(F.array(*map(F.lit, rank)), worst + 1).alias("worst"))


def indoor_probability(sky: DataFrame, keys: list[str], t: str, order: list[str], window: int = 30000, least: int = 5, grace: int = 30000) -> DataFrame:
    """Adds p_indoor and confidence to satellite reports (used, cn0, started_ms), from those of the last ``window``: the mean
    strength of the best satellites and the median number used, each between blocked and open sky. Null with fewer than
    ``least`` reports, or while the receiver still acquires. A window holds half a minute of reports."""
    by = Window.partitionBy(*keys).orderBy(t).rangeBetween(-window, 0)
    rows = sky.withColumn("_n", F.count("*").over(by)).withColumn("_cn0", F.avg("cn0").over(by)).withColumn("_u", F.sort_array(F.collect_list("used").over(by)))
    rows = rows.withColumn("_used", F.get("_u", F.floor(F.size("_u") / 2).cast("int")).cast("double"))
    scaled = lambda v, blocked, open_: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (open_ - v) / (open_ - blocked)))
    a, b = F.when(F.col("_cn0").isNull(), 1.0).otherwise(scaled(F.col("_cn0"), CN0_BLOCKED, CN0_OPEN)), scaled(F.col("_used"), USED_BLOCKED, USED_OPEN)
    acquiring = (F.col(t) - F.col("started_ms") < grace) & (F.col("_cn0").isNull() | (F.col("_used") <= USED_BLOCKED))
    known = (F.col("_n") >= least) & ~F.coalesce(acquiring, F.lit(False))
    agree, full = 1 - F.abs(a - b), F.least(F.lit(1.0), F.col("_n") / (window / 1000))
    sure = F.when((agree >= 0.7) & (full >= 0.6), "HIGH").when((agree >= 0.4) & (full >= 0.3), "MEDIUM").otherwise("LOW")
    p = F.least(F.lit(0.95), F.greatest(F.lit(0.05), 0.65 * a + 0.35 * b))
    return rows.withColumn("p_indoor", F.when(known, p)).withColumn("confidence", F.when(known, sure).otherwise("NONE")).drop("_n", "_cn0", "_u", "_used")


def holding_sessions(rows: DataFrame, keys: list[str], t: str, order: list[str]) -> DataFrame:
    """(keys, trigger, start_ms, held_ms, warm_ms, coverage, gaps_lower, gaps_upper) of rows (active, trigger, sent): a hold lasts
    while it is active with one trigger, to the next row; shorter ones than a keep-alive are left out. Warm is what sent
    keep-alives cover. A hold spans one dormancy gap at least and one for each inactivity timeout at most."""
    by = Window.partitionBy(*keys).orderBy(*order)
    sig = F.when(F.coalesce("active", F.lit(False)), F.coalesce("trigger", F.lit("")))
    cut = _islands(rows.withColumn("_s", sig).withColumn("_end", F.coalesce(F.lead(t).over(by), F.col(t))).withColumn("_was", F.lag("_s").over(by)), keys, order, ~F.col("_s").eqNullSafe(F.col("_was")) | F.col("_was").isNull() & F.col("_s").isNull()).where("_s is not null")
    out = cut.groupBy(*keys, "_island", F.col("_s").alias("trigger")).agg(F.min(t).alias("start_ms"), F.max("_end").alias("_end"), F.count_if("sent").alias("_sent"))
    return measured_holds(out, keys)


def measured_holds(out: DataFrame, keys: list[str]) -> DataFrame:
    """The holds (keys, trigger, start_ms, _end, _sent) that last a keep-alive at least, with their measures."""
    held = F.col("_end") - F.col("start_ms")
    out = out.withColumn("held_ms", held).where(F.col("held_ms") >= KEEPALIVE_MS).withColumn("warm_ms", F.least(F.col("held_ms"), F.col("_sent") * KEEPALIVE_MS))
    return out.select(*keys, "trigger", "start_ms", "held_ms", "warm_ms", F.least(F.lit(1.0), F.col("warm_ms") / F.col("held_ms")).alias("coverage"), (F.col("held_ms") > DORMANCY_MS).cast("long").alias("gaps_lower"), F.floor(F.col("held_ms") / DORMANCY_MS).alias("gaps_upper"))


def warmth_summary(sessions: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sessions, held_ms, warm_ms, gaps_lower, gaps_upper)"""
    return sessions.groupBy(*keys).agg(F.count("*").alias("sessions"), *[F.sum(c).alias(c) for c in ("held_ms", "warm_ms", "gaps_lower", "gaps_upper")])


def address_changes(links: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``address_changed``: the address differs from the last one known."""
    before = F.last("address", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return links.withColumn("address_changed", F.coalesce(F.col("address") != before, F.lit(False)))


def sort_bands(labels: Column) -> Column:
    """Band labels in order: LTE, then NR, each by number; others last, by name."""
    key = lambda x: F.struct(x.startswith("n").cast("int").alias("nr"), F.coalesce(F.expr("try_cast(1 as int)") * F.try_to_number(F.substring(x, 2, 9), F.lit("999999999")).cast("int"), F.lit(2147483647)).alias("n"), x.alias("x"))
    return F.transform(F.array_sort(F.transform(labels, key)), lambda s: s["x"])


def next_batch(rows: DataFrame, mark: int, n: int = 20000) -> DataFrame:
    """The first ``n`` rows by (wall_ms, id) behind a mark."""
    return rows.where(F.col("id") > mark).orderBy("wall_ms", "id").limit(n)
