"""What the operators of this subpackage share: checkpoints, table reading and connected components."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


HUBS, HUB_EDGES = 1024, 1000  # nodes of many edges that are broadcast at most; edges they have at least


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where the session names none, one of this machine if Spark runs on it alone, as in
    tests; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of ``df`` kept in the shared checkpoint folder, so that a lost executor repeats no lineage before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of results that are no longer in use; it waits for a collection of garbage to do so."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node it reaches.

    Alternates the two star steps of Kiveris et al. (2014): every node hands its larger neighbours, then its smaller
    ones, to its smallest neighbour. Minima are partially aggregated and joined back, so no neighbourhood is collected.
    Self-loops are dropped, repeated edges count once, nulls are ignored; no edges give no rows. Rounds go on until the edges
    stay as they are; each brings every node's neighbours nearer to the root, so that comes.
    """

    def star(pairs: DataFrame, larger: bool, total: int) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if larger else pairs
        both = both.toDF("u", "v")
        many = max(HUB_EDGES, 2 * total // HUBS)
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        # a node of very many edges, as the root of a large group is, would send them to one task: such nodes, HUBS at most, come to
        # their edges instead
        hubs = F.broadcast(least.where(F.col("n") >= many).select("u", F.col("m").alias("_hub")))
        told = both.join(hubs, "u", "left")
        rest = told.where("_hub is null").select("u", "v").join(least.where(F.col("n") < many).select("u", "m"), "u")
        out = told.where("_hub is not null").select("u", "v", F.col("_hub").alias("m")).union(rest.select("u", "v", "m"))
        if larger:
            out = out.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return out.where("a <> b").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now = cut(now)
    seen = mark(now)
    while seen[0]:
        grown = cut(star(now, True, seen[0]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        now = cut(star(grown, False, seen[0]).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        last, seen = seen, mark(now)
        if seen == last:
            break
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return pairs.union(now.select("b", "b").distinct().toDF("node", "root")).groupBy("node").agg(F.min("root").alias("root"))
