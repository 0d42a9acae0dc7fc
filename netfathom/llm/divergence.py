"""Source divergence audit: how far the term distributions of sources lie apart, by Gustavson row accumulation.

A group is a source within a language. Its smoothed shares p are integers (parts of 10**9), and two shares differ by
f = floor((p - q)**2 / (p + q)). The sum of f over all terms of two groups is a product of a sparse matrix with its transpose,
but for terms that a group lacks, which have a share too. So, for groups g and h with shares g0 and h0 of what they lack:

    V f(g0, h0) + sum over g's terms of [f(p, h0) - f(g0, h0)] + sum over h's terms of [f(g0, q) - f(g0, h0)]
                + sum over common terms of [f(p, q) - f(p, h0) - f(g0, q) + f(g0, h0)]

Tasks hold blocks of a term-major index. Row by row, a group scatters its terms through the block's index into a dense
accumulator over its peers (the common terms), to which the block's terms of each group add their zero baselines, by their
counts. Accumulators of the blocks are summed by Spark. No pair of postings is emitted: a block emits one value a pair of
groups at most, and blocks are made large enough that these are no more than its postings.

Null texts, languages and sources are empty; repeated rows count as documents of their own; an empty table gives no rows; other
columns are ignored. All arithmetic is exact while a language has fewer than 9 * 10**15 terms occurring. What is broadcast are
16 bytes a group (of which the result has a row for each pair in a language).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, width

TERM = re.compile(rb"[A-Za-z\x80-\xFF]+")
PARTS, SMOOTH, LEAST_DOCS, TOP = 10**9, 2, 10, 10
FLUSH = 400_000
BLOCK = 1 << 18  # postings of a block, at least
SLICE = 1 << 20  # postings that a task handles at a time, and places of a dense sum


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs), summed as far as the task's memory goes."""
    total: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in total.items():
            k = len(n)
            if k:
                yield pa.record_batch([pa.array([lang] * k, pa.string()), pa.array([source] * k, pa.string()), pa.array(list(n), pa.binary()).cast(pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([docs[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
        total.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
            terms = TERM.findall((text.as_py() or b"").lower())
            n, docs = total.setdefault((lang, source), (Counter(), Counter()))
            held -= len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n)
            if held > FLUSH:
                yield from out()
                held = 0
    yield from out()


def share(n, total, terms):
    """1 + floor(PARTS * (n + SMOOTH) / (total + SMOOTH * terms)) in 64-bit integers, three digits of the quotient at a time."""
    rest, below = n + SMOOTH, total + SMOOTH * terms
    out = np.zeros_like(rest)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def distance(p, q):
    return (p - q) ** 2 // (p + q)


def _share(n: str) -> Column:
    return F.expr(f"1 + CAST({PARTS} * (CAST({n} AS DECIMAL(38, 0)) + {SMOOTH}) AS DECIMAL(38, 0)) div CAST(total + {SMOOTH} * terms AS DECIMAL(38, 0))")


class Peers:
    """Of each language: total and share of a missing term of its groups, by number, and how many terms it keeps."""

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        self.by: dict[int, tuple[np.ndarray, np.ndarray, int]] = {}
        lists: dict[int, list[tuple[int, int]]] = {}
        for lang, peer, total, terms in rows:
            lists.setdefault(lang, []).append((peer, total))
            self.by[lang] = (None, None, terms)
        for lang, own in lists.items():
            terms = self.by[lang][2]
            total = np.array([t for _, t in sorted(own)], np.int64)
            self.by[lang] = (total, share(np.zeros_like(total), total, terms) if terms else total * 0 + 1, terms)


def _rows(lang: int, g: int, values: np.ndarray, at: np.ndarray | None = None) -> pa.RecordBatch:
    at = np.flatnonzero(values) if at is None else at
    k = len(at)
    return pa.record_batch([pa.array(np.full(k, lang, np.int32)), pa.array(np.full(k, g, np.int32)), pa.array(at.astype(np.int32)), pa.array(values[at])], names=["lang_no", "g", "h", "value"])


def _accumulate(peers):
    """(lang_no, g, h, value) for g < h: what a block of postings (lang_no, term, g, n), sorted by language and term, adds to
    the sums of its groups."""

    def block(lang: int, new: np.ndarray, g: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        total, zero, terms = peers.value.by[lang]
        p = share(n, total[g], terms)
        term = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(g)))
        order = np.argsort(g, kind="stable")
        cut_at = np.flatnonzero(np.diff(g[order])) + 1
        for own in np.split(order, cut_at):
            me = int(g[own[0]])
            acc = np.zeros(len(total), np.int64)
            mine, below = zero[me], zero
            none = distance(mine, below)
            shares, times = np.unique(p[own], return_counts=True)
            for s in range(0, len(shares), max(1, SLICE // len(total))):
                part = slice(s, s + max(1, SLICE // len(total)))
                acc += (times[part, None] * (distance(shares[part, None], below[None, :]) - none[None, :])).sum(0)
            for s in range(0, len(own), 4096):  # through the index, some terms at a time
                t = term[own[s : s + 4096]]
                many = size[t]
                at = np.repeat(first[t] - (np.cumsum(many) - many), many) + np.arange(many.sum())
                mate, q, o = g[at], p[at], np.repeat(p[own[s : s + 4096]], many)
                more = mate > me  # the other half is its mirror
                mate, q, o = mate[more], q[more], o[more]
                np.add.at(acc, mate, distance(o, q) - distance(o, zero[mate]) - distance(mine, q) + none[mate])
            acc[me] = 0
            yield me, acc

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def told(lang: int, new, g, n) -> Iterator[pa.RecordBatch]:
            many = len(peers.value.by[lang][0])
            dense = many * many <= SLICE
            for me, acc in block(lang, new, g, n):
                if dense:
                    sums.setdefault(lang, np.zeros((many, many), np.int64))[me] += acc
                else:
                    yield _rows(lang, me, acc)

        kept: list[tuple] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            """Handles the terms that are whole; the last one may go on in the next batch."""
            nonlocal kept, held
            if not kept:
                return
            lang, term, g, n = (np.concatenate(x) for x in zip(*kept))
            new = np.ones(len(g), bool)
            new[1:] = (term[1:] != term[:-1]) | (lang[1:] != lang[:-1])
            end = len(g) if last else int(np.flatnonzero(new)[-1])
            for number in np.unique(lang[:end]).tolist():
                a, b = np.searchsorted(lang[:end], [number, number + 1])
                yield from told(number, new[a:b], g[a:b], n[a:b])
            kept, held = ([(lang[end:], term[end:], g[end:], n[end:])], len(g) - end) if end < len(g) else ([], 0)

        for batch in batches:
            if batch.num_rows:
                kept.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
                held += batch.num_rows
            if held > SLICE:
                yield from flush(False)
        yield from flush(True)
        for lang, rows in sums.items():
            for me in np.flatnonzero(rows.any(1)).tolist():
                yield _rows(lang, me, rows[me])

    return run


def _baselines(peers):
    """(lang_no, g, h, value) for all g and h > g: the sums if no group had a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, me in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, zero, terms = peers.value.by[lang]
                yield _rows(lang, me, terms * distance(zero[me], zero), np.arange(me + 1, len(zero)))

    return run


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for ``docs`` (lang, source, text): part ``pair`` ranks a group's peers by the sum of
    f over all terms that at least ``least_docs`` documents of the language have, part ``term`` its ``top`` terms of a greater
    share than in the whole language, by f."""
    spark = docs.sparkSession
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counts = named.mapInArrow(_terms, "lang string, source string, term string, n long, docs long").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select("*", F.sum("docs").over(of_term).alias("of_docs"), F.sum("n").over(of_term).alias("of_lang"), (F.row_number().over(of_term.orderBy("source")) == 1).alias("first"))
    kept = cut(kept.where(F.col("of_docs") >= least_docs).drop("docs", "of_docs"))

    found = named.select("lang", "source").distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("first").cast("long")).alias("terms"), F.count("*").alias("postings"))
    whole = Window.partitionBy("lang")
    groups = found.join(sums, ["lang", "source"], "left").na.fill(0, ["total", "terms", "postings"])
    langs = groups.groupBy("lang").agg(F.sum("total").alias("of_total"), F.sum("terms").alias("terms"))
    langs = langs.withColumn("lang_no", F.row_number().over(Window.orderBy("lang")) - 1)
    groups = cut(groups.drop("terms").join(langs, "lang").withColumn("g", F.row_number().over(whole.orderBy("source")) - 1))
    rows = groups.select("lang_no", "g", "total", "terms", "postings").collect()  # a row a group; the result has one a pair
    peers = spark.sparkContext.broadcast(Peers([tuple(r)[:4] for r in rows]))
    most = max((len(x[0]) for x in peers.value.by.values()), default=1)
    blocks = max(1, min(4 * width(spark), sum(r[4] for r in rows) // max(BLOCK, most * most)))

    postings = kept.join(groups.select("lang", "source", "lang_no", "g"), ["lang", "source"]).select("lang_no", F.xxhash64("term").alias("term"), "g", "n")
    postings = postings.repartition(blocks, "lang_no", "term").sortWithinPartitions("lang_no", "term")
    kind = "lang_no int, g int, h int, value long"
    half = postings.mapInArrow(_accumulate(peers), kind)
    # what a group adds by its own terms holds for smaller numbers too: both orders are one pair
    half = half.select("lang_no", F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h"), "value")
    half = half.union(groups.select("lang_no", "g").mapInArrow(_baselines(peers), kind)).groupBy("lang_no", "g", "h").agg(F.sum("value").alias("value"))
    both = half.select("lang_no", F.explode(F.array(F.struct("g", "h"), F.struct(F.col("h").alias("g"), F.col("g").alias("h")))).alias("x"), "value").select("lang_no", "x.g", "x.h", "value")
    name = groups.select("lang_no", "g", "lang", "source")
    pairs = both.join(name, ["lang_no", "g"]).join(name.select("lang_no", F.col("g").alias("h"), F.col("source").alias("item")), ["lang_no", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(order))

    terms = kept.join(groups.select("lang", "source", "total", "terms", "of_total"), ["lang", "source"]).withColumn("p", _share("n"))
    terms = terms.withColumn("total", F.col("of_total")).withColumn("q", _share("of_lang")).where("p > q")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pairs.union(terms)
