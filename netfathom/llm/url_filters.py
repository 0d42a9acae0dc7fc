"""URL filters: path rules, and propagation over the host graph for what no rule decides.

Trusted hosts are those of pages that a rule allows, blocked ones those of pages that a rule blocks, each weighted by its
pages; both masses are shares of all seeded pages, so that they are on one scale. Trust is a personalised PageRank along
host edges from the trusted seeds; distrust runs along the reversed edges from the blocked seeds, so a host that links to
bad hosts is doubted. A host is blocked where its odds of distrust to trust are more than ``lift`` times those of the
seeds, so the threshold follows the share of blocked seeds. Rounds go on until the masses move by less than
``tolerance`` in all; as each round keeps ``damping`` of them, that comes always.

Host edges come from the pages' html: absolute links, and addresses in the text, to another host; and menus, that is
relative links whose path the pages of several hosts share, as mirrors and farms of one template do. A menu path is a
point between its hosts that is passed within one round, so the pairs of its hosts are never formed.

Everything is DataFrame work on columns. Edges are aggregated per pair before any join; what is known of a host comes to
its pages by one join on the host, where hosts of more than a partition's share of the pages are met by broadcast.

A null url, or one without ``://``, has an empty host and path; it meets no rule and is allowed. Null html has no links.
Repeated pages count each time. Of rules of one length the first in order counts. Odds just at the threshold allow, and so
do all where nothing is trusted or nothing blocked. A host without edges keeps its own seeds. Other columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, width

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Host of an absolute link, or of an address in the text.
LINK = r"(?i)(?:[a-z][a-z0-9+.-]*:|(?:href|src|action)\s*=\s*[\"']?\s*)//([^/?#\"'\s<>]+)"
#: Path of a relative link.
MENU = r"(?i)href\s*=\s*[\"']?(/[^/?#\"'\s<>][^?#\"'\s<>]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def rule_table(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, rule_host, rule_path) of rules given as such tuples."""
    quoted = ", ".join("(" + ", ".join("'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in r) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {quoted} AS rules(verdict, rule_host, rule_path)") if rules else spark.sql("SELECT '' verdict, '' rule_host, '' rule_path WHERE false")


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, rules) of hosts that some rule fits: its rules, the longest first. A host meets the rules by its last labels, no
    more of them than rules have."""
    labels = F.split("host", r"\.")
    most = rules.agg(F.max(F.size(F.split("rule_host", r"\.")))).first()[0] or 0
    ends = F.transform(F.sequence(F.lit(1), F.least(F.size(labels), F.lit(max(1, most)))), lambda n: F.array_join(F.slice(labels, -n, n), "."))
    open_ = hosts.where("host <> ''").select("host", F.explode(ends).alias("rule_host"))
    rule = F.concat("rule_host", "rule_path")
    each = F.struct((-F.length(rule)).alias("size"), rule.alias("rule"), "rule_path", "verdict")
    return open_.join(rules, "rule_host").groupBy("host").agg(F.sort_array(F.collect_list(each)).alias("rules"))


def host_edges(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From pages (host, html): links (src, dst, weight) between different hosts, and menus (host, path, weight) of the paths
    that several hosts share. Weights count pages."""
    html = F.coalesce("html", F.lit(""))
    found = lambda pattern: F.explode(F.array_distinct(F.regexp_extract_all(html, F.lit(pattern), F.lit(1))))
    own = pages.where("host <> ''")
    links = own.select(F.col("host").alias("src"), found(LINK).alias("dst")).select("src", F.translate("dst", _UPPER, _LOWER).alias("dst"))
    links = links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    menus = cut(own.select("host", found(MENU).alias("path")).groupBy("host", "path").agg(F.count("*").cast("double").alias("weight")))
    shared = menus.groupBy("path").agg(F.count("*").alias("hosts"), F.sum("weight").alias("all")).where("hosts > 1")
    return links, menus.join(shared, "path").select("host", "path", "weight", "all")


def propagate(links: DataFrame, menus: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """(host, trust, distrust) from seeds (host, allowed, blocked); menus (host, path, weight, all) with the path's weight."""
    one = lambda df, host, ahead, back: df.select(F.col(host).alias("host"), ahead.alias("ahead"), back.alias("back"))
    w, none = F.col("weight"), F.lit(0.0)
    sums = one(links, "src", w, none).union(one(links, "dst", none, w)).union(one(menus, "host", w, w)).groupBy("host").agg(F.sum("ahead").alias("ahead"), F.sum("back").alias("back"))
    sums = cut(sums)
    forth = links.join(sums, links["src"] == sums["host"]).select("host", F.col("dst").alias("to"), (w / F.col("ahead") * damping).alias("t"), none.alias("d"))
    back = links.join(sums, links["dst"] == sums["host"]).select("host", F.col("src").alias("to"), none.alias("t"), (w / F.col("back") * damping).alias("d"))
    ways = cut(forth.union(back).groupBy("host", "to").agg(F.sum("t").alias("t"), F.sum("d").alias("d")))
    points = cut(menus.join(sums, "host").select("host", "path", (w / F.col("ahead") * damping).alias("t"), (w / F.col("back") * damping).alias("d"), (w / F.col("all")).alias("share")))

    total = seeds.agg(F.sum(F.col("allowed") + F.col("blocked"))).first()[0] or 1
    base = cut(seeds.select("host", (F.col("allowed") / total).alias("trust"), (F.col("blocked") / total).alias("distrust")))
    own = base.select("host", (F.col("trust") * (1 - damping)).alias("trust"), (F.col("distrust") * (1 - damping)).alias("distrust"))

    def given(ranks: DataFrame) -> DataFrame:
        scaled = lambda t, d: [(F.col("trust") * t).alias("trust"), (F.col("distrust") * d).alias("distrust")]
        straight = ways.join(ranks, "host").select(F.col("to").alias("host"), *scaled(F.col("t"), F.col("d")))
        at = points.join(ranks, "host").select("path", *scaled(F.col("t"), F.col("d"))).groupBy("path").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust"))
        return straight.union(at.join(points, "path").select("host", *scaled(F.col("share"), F.col("share")))).union(own)

    ranks = base
    while True:
        was = ranks.select("host", F.lit(0.0).alias("trust"), F.lit(0.0).alias("distrust"), F.col("trust").alias("_t"), F.col("distrust").alias("_d"))
        both = given(ranks).select("*", F.lit(0.0).alias("_t"), F.lit(0.0).alias("_d")).union(was).groupBy("host").agg(*[F.sum(c).alias(c) for c in ("trust", "distrust", "_t", "_d")])
        both = cut(both)
        moved = both.agg(F.sum(F.abs(F.col("trust") - F.col("_t")) + F.abs(F.col("distrust") - F.col("_d")))).first()[0] or 0.0
        ranks = both.select("host", "trust", "distrust")
        if moved <= tolerance:
            return ranks


def _beside(rows: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` (page_id, host, path) with ``h``: the row of ``known`` (host, pages, ...) of their host. Hosts with more pages
    than an equal share of a partition are broadcast, no more of them than there are partitions; rows without a host, and
    those already met, get keys of their own for the other join, so that they do not gather in one task."""
    parts = width(rows.sparkSession)
    total = known.agg(F.sum("pages")).first()[0] or 0
    told = known.select(F.col("host").alias("_host"), F.struct(*known.columns).alias("_h"))
    often = F.col("_h.pages") * parts > total
    met = rows.join(F.broadcast(told.where(often)), F.col("host") == F.col("_host"), "left").withColumnRenamed("_h", "_hot").drop("_host")
    alone = F.concat(F.lit("\u0000"), F.xxhash64("page_id", "host", "path").cast("string"))
    met = met.withColumn("_key", F.when((F.col("host") != "") & F.col("_hot").isNull(), F.col("host")).otherwise(alone))
    return met.join(told.where(~often), F.col("_key") == F.col("_host"), "left").select("page_id", "host", "path", F.coalesce("_hot", "_h").alias("h"))


def _ruled(met: DataFrame) -> DataFrame:
    fits = F.get(F.filter("h.rules", lambda r: F.col("path").startswith(r["rule_path"])), F.lit(0))
    return met.withColumn("_r", fits).select("*", F.col("_r.rule").alias("rule"), F.col("_r.verdict").alias("_verdict")).drop("_r")


def filter_urls(pages: DataFrame, rules: DataFrame, lift: float = 1.2, damping: float = 0.85, tolerance: float = 1e-4) -> DataFrame:
    """Per row of ``pages`` (page_id, url, html): page_id, host, path, rule, verdict, trust, distrust."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    counted = cut(split.where("host <> ''").groupBy("host").agg(F.count("*").alias("pages")))
    known = cut(counted.join(rules_of_hosts(counted, rules), "host", "left"))
    of = lambda verdict: F.count_if(F.col("_verdict") == verdict).alias(f"{verdict}ed")
    seeds = cut(_ruled(_beside(split, known)).where("rule is not null").groupBy("host").agg(of("allow"), of("block")))
    links, menus = host_edges(pages.select(host_of(F.col("url")).alias("host"), "html"))
    ranks = propagate(cut(links), menus, seeds, damping, tolerance)
    good, bad = seeds.agg(F.sum("allowed"), F.sum("blocked")).first()
    doubted = F.coalesce(F.col("distrust") * (good or 0) > lift * (bad or 0) * F.col("trust"), F.lit(False)) if good and bad else F.lit(False)
    scored = cut(known.join(ranks, "host", "left").select("host", "pages", "rules", doubted.alias("doubted"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust")))
    out = _ruled(_beside(split, scored))
    verdict = F.coalesce("_verdict", F.when(F.col("h.doubted"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.coalesce("h.trust", F.lit(0.0)).alias("trust"), F.coalesce("h.distrust", F.lit(0.0)).alias("distrust"))
