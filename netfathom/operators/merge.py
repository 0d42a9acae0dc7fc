"""The adaptive merge of hexagonal bins, from resolution 10 to 6.

At each level the bins below a parent either merge into it or stay: they stay where too little of the parent was surveyed, or
several networks meet; they merge where some bin is thin (few contributors or samples); else they merge if their outcomes
agree, their intervals overlap, and no well-founded one is worse than the merged bin would be. Bins that stay leave the walk;
leaves of the next resolution join it, and one of the same cell and network is added to. Coarser leaves are always reached,
also past a level without bins. A leaf that lies in a coarser leaf of its network is folded into that first.

The accumulator of a bin is a row of sums and, beside it, rows of one table of sides: (cell, plmn, measure, value, weight) with the
contributors (``member``), latencies, histograms, serving cells and errors. All of them are moved to the new cell of their bin
in one step a level, so any measure that is a sum over values merges exactly, percentiles included; contributors are counted,
never summed. What is not a sum follows the bins: the subscription of most time, and of the causes the one that bins of most
time have.

Levels are unrolled, not recursive: one aggregate per level and a join on the parent. Two bins overlap pairwise if and only if
the largest lower bound is not above the smallest upper bound, so no pairs are formed. Null cells or networks are not to be
given; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hexgrid
from ..functions.stats import effective_n, fraction, percentiles, wilson
from .bins import SUMS, latency_p90, measure_columns, outcome_columns
from .lineage import cut

# fixed values
K, N, MIN_COVERAGE = 5, 30, 0.35
SEVERITY = {"LTE": 0, "ROUTE_LOSS": 4, "ANCHOR": 3, "RESELECT": 1, "SLOW": 3, "NSA": 1, "UNSURVEYED": 1}


def _severity(outcome):
    return reduce(lambda out, kv: F.when(outcome == kv[0], kv[1]).otherwise(out), SEVERITY.items(), F.lit(0))


COUNTS = ["flaps", "probe_n", "probe_fail", "no_bearer_n", "cold_n", "cold_fail", "other_n"]
CAUSES = range(1, 8)
Outcome = Callable[[DataFrame, DataFrame], DataFrame]


def _sums(bins: DataFrame) -> list[str]:
    return [c for c in [*SUMS, *COUNTS, "leaf_count"] if c in bins.columns]


class Combination:
    """Bins of the same keys as one: sums added, the subscription of most time (then samples, then the lowest), when first and last
    seen, and the cause that bins of most time have, with its share of the time. Only columns that ``bins`` has. The expressions
    are made once, for all tables of these columns."""

    def __init__(self, bins: DataFrame):
        has = set(bins.columns)
        self.sums = [F.sum(c).alias(c) for c in _sums(bins)]
        if "sub_id" in has:
            self.sums.append(F.max_by("sub_id", F.struct("ms", "n", -F.col("sub_id"))).alias("sub_id"))
        if "first_ms" in has:
            self.sums += [F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms")]
        self.cause = {}
        if "cause" in has:
            codes = [f"_c{k}" for k in CAUSES]
            self.sums += [F.sum(F.when(F.col("cause") == k, F.col("ms"))).alias(f"_c{k}") for k in CAUSES]
            top = F.greatest(*[F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("ms"), F.lit(-k).alias("k"))) for c, k in zip(codes, CAUSES)])
            self.cause = {"_top": top}
            self.named = {"cause": F.coalesce(-F.col("_top.k"), F.lit(0)), "cause_share": F.coalesce(fraction(F.col("_top.ms"), F.col("ms")), F.lit(0.0))}

    def __call__(self, bins: DataFrame, keys: list[str], *more: Column) -> DataFrame:
        made = bins.groupBy(*keys).agg(*self.sums, *more)
        return made.withColumns(self.cause).withColumns(self.named).drop("_top", *[f"_c{k}" for k in CAUSES]) if self.cause else made


def combined(bins: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """``bins`` of the same keys as one; ``more`` are further aggregates."""
    return Combination(bins)(bins, keys, *more)


def moved(sides: DataFrame, to: DataFrame) -> DataFrame:
    """The sides of bins (cell, plmn) at their new place (cell, plmn, place), added up there; others stay."""
    rows = sides.join(to.select("cell", "plmn", "place"), ["cell", "plmn"], "left")
    return rows.groupBy(F.coalesce("place", "cell").alias("cell"), "plmn", "measure", "value").agg(F.sum("weight").alias("weight"))


def hosts(leaves: DataFrame) -> DataFrame:
    """(cell, plmn, place): of leaves that lie in coarser ones of their network, the coarsest of these. A host goes on into its own,
    and all of them lie on one line of ancestors."""
    own = leaves.select("cell", "plmn").distinct()
    levels = range(hexgrid.FINEST, hexgrid.COARSEST, -1)
    line = own
    for r in levels:
        line = line.withColumn(f"_{r - 1}", hexgrid.parent_from(F.col(f"_{r}" if r < hexgrid.FINEST else "cell"), r))
    above = line.select("cell", "plmn", F.explode(F.array_distinct(F.array(*[f"_{r - 1}" for r in levels]))).alias("place")).where("place <> cell")
    there = own.select(F.col("cell").alias("place"), "plmn")
    return above.join(there, ["place", "plmn"]).groupBy("cell", "plmn").agg(F.min_by("place", hexgrid.res_of(F.col("place"))).alias("place"))


def merge_walk(leaves: DataFrame, sides: DataFrame, outcome_of: Outcome, k: int = K, n: int = N, least: float = MIN_COVERAGE, collapse: bool = True) -> tuple[DataFrame, DataFrame]:
    """The published bins (cell, plmn, sums, units, leaf_count, outcome, reason, and sub_id, cause, cause_share, first_ms and last_ms
    if ``leaves`` have them) and their sides.

    ``leaves``: (cell, plmn, sums) of any resolution 10 to 6; ``sides``: as above, of the leaves; ``outcome_of`` adds ``outcome`` to
    bins, given their sides.
    """
    leaves = leaves.withColumn("leaf_count", F.lit(1).cast("long"))
    if "cause" in leaves.columns:
        leaves = leaves.withColumn("cause_share", F.when(F.col("cause") != 0, fraction(F.col("ms"), F.col("ms"))).otherwise(0.0))
    native = leaves.withColumn("units", hexgrid.child_units(hexgrid.res_of(F.col("cell")))).withColumn("reason", F.lit("leaf"))
    at = hexgrid.res_of(F.col("cell"))
    room, units, combine = hexgrid.child_units(at), F.sum("units").alias("units"), Combination(native)
    ci = wilson(F.coalesce(fraction(F.col("validated_ms"), F.col("ms")), F.lit(0.0)), effective_n(F.col("ms"), F.col("ms_sq")))
    bounds = {"_lo": ci["lo"], "_hi": ci["hi"]}
    solid, severity = F.col("contributors") >= k, _severity(F.col("outcome"))
    flags = [
        units, F.countDistinct("plmn").alias("_plmns"), F.min("plmn").alias("plmn"), F.bool_or(~solid | (F.col("n") < n)).alias("_thin"), F.countDistinct("outcome").alias("_outcomes"),
        (F.max("_lo") <= F.min("_hi")).alias("_overlap"), F.max(F.when(solid, severity)).alias("_worst"),
    ]
    blocked = F.coalesce(F.col("_worst") > severity, F.lit(False))
    weight = F.sum("weight").alias("weight")
    if collapse:
        leaves = cut(native)
        to = cut(hosts(leaves))
        native = combine(leaves.join(to, ["cell", "plmn"], "left").withColumn("cell", F.coalesce("place", "cell")), ["cell", "plmn"], units).withColumn("units", F.least("units", room))
        native = native.withColumn("reason", F.when(F.col("leaf_count") > 1, "folded: coarser ground").otherwise("leaf"))
        sides = moved(sides, to)
    native, sides = cut(native), cut(sides.groupBy("cell", "plmn", "measure", "value").agg(weight))
    names = native.columns
    now = native.where(at == hexgrid.FINEST)
    published = []
    for res in range(hexgrid.FINEST, hexgrid.COARSEST, -1):
        here, place = sides.where(at == res), hexgrid.parent_from(F.col("cell"), res)
        people = here.where("measure = 'member'").groupBy("cell", "plmn").agg(F.count("*").alias("contributors"))
        kids = outcome_of(now, here).select(*names, "outcome").join(people, ["cell", "plmn"], "left").withColumns({**bounds, "contributors": F.coalesce("contributors", F.lit(0)), "place": place})
        groups = combine(kids, ["place"], *flags)
        above = here.withColumn("cell", place).groupBy("cell", "plmn", "measure", "value").agg(weight)
        whole = outcome_of(groups.withColumnRenamed("place", "cell"), above)
        reason = F.when(F.col("units") / float(7 ** (hexgrid.FINEST - res + 1)) < least, "held: surveyed too little").when(F.col("_plmns") > 1, "held: several networks").when(F.col("_thin"), "merged: thin").when(F.col("_outcomes") > 1, "held: outcomes differ").when(~F.col("_overlap"), "held: intervals apart").when(blocked, "held: a worse bin").otherwise("merged: alike")
        fate = cut(kids.drop("reason").join(whole.select(F.col("cell").alias("place"), reason.alias("reason")), "place"))
        published.append(fate.where("startswith(reason, 'held')").select(*names, "outcome"))
        rising = fate.where("startswith(reason, 'merged')")
        sides = cut(moved(sides, rising))
        risen = combine(rising.withColumn("cell", F.col("place")), ["cell", "plmn"], units, F.max("reason").alias("reason"))
        now = combine(risen.select(*names).union(native.where(at == res - 1)), ["cell", "plmn"], units, F.max("reason").alias("reason")).withColumn("units", F.least("units", F.lit(7 ** (hexgrid.FINEST - res + 1)))).select(*names)
    last = outcome_of(now, sides.where(at == hexgrid.COARSEST)).select(*names, "outcome")
    return reduce(DataFrame.union, [*published, last]), sides


def adaptive_merge(leaves: DataFrame, members: DataFrame, outcome_of: Callable[[DataFrame], DataFrame], k: int = K, n: int = N, least: float = MIN_COVERAGE) -> DataFrame:
    """(cell, plmn, sums, units, outcome, reason) of the published bins of ``leaves`` that have no sides but their ``members`` (cell,
    plmn, device), and are not folded."""
    sides = members.select("cell", "plmn", F.lit("member").alias("measure"), F.col("device").cast("string").alias("value"), F.lit(1).cast("long").alias("weight")).distinct()
    return merge_walk(leaves, sides, lambda b, _: outcome_of(b), k, n, least, collapse=False)[0].drop("leaf_count")


def latencies_of(bins: DataFrame, sides: DataFrame) -> DataFrame:
    """Adds ok_n and p90_ms, of the latencies among the sides."""
    hist = sides.where("measure = 'latency'").select("cell", "plmn", F.col("value").cast("long").alias("latency_bin"), "weight")
    return bins.join(latency_p90(hist, ["cell", "plmn"]), ["cell", "plmn"], "left")


def classifier() -> Outcome:
    """Adds ``outcome`` by all rules of the map; the rules' expressions are made once."""
    (zero, derived), outcome = measure_columns(), outcome_columns()
    return lambda bins, sides: latencies_of(bins, sides).withColumns(zero).withColumns(derived).withColumns(outcome)


def described(bins: DataFrame, sides: DataFrame) -> DataFrame:
    """Adds contributors, cells (serving cells), the dominant rat and band, the medians of rsrp and sinr, ok_n and p90_ms."""
    keys = ["cell", "plmn"]
    top = lambda m: F.min(F.when((F.col("measure") == m) & (F.col("weight") > 0), F.struct((-F.col("weight")).alias("w"), F.col("value").alias("v"))))["v"]
    counts = sides.groupBy(*keys).agg(F.count_if(F.col("measure") == "member").alias("contributors"), F.count_if(F.col("measure") == "serving").alias("cells"), top("rat").alias("rat"), top("band").alias("band"))
    signal = sides.where("measure in ('rsrp', 'sinr')").select(*keys, "measure", F.col("value").cast("int").alias("_v"), "weight")
    medians = percentiles(signal, [*keys, "measure"], "_v", "A", _p50=0.5).groupBy(*keys).agg(*[F.max(F.when(F.col("measure") == m, F.col("_p50"))).alias(f"{m}_p50") for m in ("rsrp", "sinr")])
    return latencies_of(bins.join(counts, keys, "left").join(medians, keys, "left"), sides)
