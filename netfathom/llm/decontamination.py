"""Benchmark decontamination by Wu-Manber search over words.

The "characters" of the search are words (as 64-bit hashes) and a block is two of them. For patterns of m words, the
shift table says of each hashed block how far the window may move before a pattern can end: m - 1 for a block that is
in no pattern, 0 for one that ends some pattern. At a shift of 0 the suffix block selects a bucket of patterns, their
first block thins it out, and all m words are compared. Many places of the text are searched at once: a cursor runs
over each stretch of ``LANE`` words. Patterns of each length have tables of their own.

The benchmark is taken in portions of at most ``PORTION_BYTES`` of text, each broadcast by itself; with more than one
portion the documents pass several times and carry what was hit.

Null texts have no words. Benchmark rows without words are left out; rows of one id are one item. The windows of a row with a
null id hit words too, but are of no item that is counted or named. An empty table of documents gives no rows, an empty benchmark
hits nothing. A very long text is searched as a whole, in a block of its own.
Repeated documents are judged alike, and documents' other columns are ignored (``contamination``) or kept
(``decontaminate``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import ALNUM, U64, blocks, mix

PORTION_BYTES = 16 << 20
LANE = 128


def _pairs(words: np.ndarray) -> np.ndarray:
    """The block that ends at each word; the first word's is of no use."""
    out = np.zeros(len(words), U64)
    out[1:] = mix(mix(words[:-1]) + words[1:])
    return out


class Patterns:
    """Tables for patterns of one length: ``flat`` the words of all items, ``start`` where in it each pattern begins, and the
    numbers of its items, ``item[item_at[i]:item_at[i + 1]]``."""

    def __init__(self, m: int, flat: np.ndarray, start: np.ndarray, item_at: np.ndarray, item: np.ndarray):
        self.m, self.flat, self.item_at, self.item = m, flat, item_at, item
        ends = _pairs(flat) if m > 1 else mix(flat)
        bits = min(24, max(16, math.ceil(math.log2(max(2, len(start) * m))) + 4))
        self.down = U64(64 - bits)
        self.shift = np.full(1 << bits, max(1, m - 1), np.uint8 if m < 256 else np.int32)
        for q in range(m - 1, 0 if m > 1 else -1, -1):
            np.minimum.at(self.shift, (ends[start + q] >> self.down).astype(np.int64), m - 1 - q)
        self.number = np.argsort(ends[start + m - 1], kind="stable")
        self.start = start[self.number]
        suffix = ends[self.start + m - 1]
        self.prefix = ends[self.start + min(1, m - 1)]
        self.suffix, self.bucket = np.unique(suffix, return_index=True)
        self.bucket = np.append(self.bucket, len(suffix))

    def items(self, pattern: int) -> np.ndarray:
        n = self.number[pattern]
        return self.item[self.item_at[n] : self.item_at[n + 1]]

    def search(self, words: np.ndarray, pairs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern of each occurrence inside a document."""
        m = self.m
        ends = pairs if m > 1 else mix(words)
        at = (ends >> self.down).astype(np.int64)
        count = np.maximum(0, np.diff(bounds) - m + 1)
        lanes = -(-count // LANE)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        here = np.repeat(bounds[:-1] + m - 1, lanes) + number * LANE
        stop = np.minimum(here + LANE, np.repeat(bounds[1:], lanes))
        found = []
        while len(here):
            step = self.shift[at[here]].astype(np.int64)
            found.append(here[step == 0])
            here = here + np.maximum(step, 1)
            going = here < stop
            here, stop = here[going], stop[going]
        p = np.concatenate(found) if found else np.zeros(0, np.int64)
        b = np.searchsorted(self.suffix, ends[p])
        own = (b < len(self.suffix)) & (self.suffix[np.minimum(b, len(self.suffix) - 1)] == ends[p])
        p, b = p[own], b[own]
        size = self.bucket[b + 1] - self.bucket[b]
        p, pattern = np.repeat(p, size), np.repeat(self.bucket[b] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        near = self.prefix[pattern] == ends[p - m + 1 + min(1, m - 1)]
        p, pattern = p[near], pattern[near]
        same = np.ones(len(p), bool)
        for j in range(m):
            same &= words[p - m + 1 + j] == self.flat[self.start[pattern] + j]
        return p[same], pattern[same]


class Tables:
    """The patterns of benchmark rows (id, text), by length; a window of several items is one pattern. Windows of a row without
    an id have no item."""

    def __init__(self, rows: list[tuple[str | None, str]], window: int):
        self.names, at = np.unique([i for i, _ in rows if i is not None], return_inverse=True)
        number = np.full(len(rows), -1)
        number[[i is not None for i, _ in rows]] = at
        words, size = [], []
        for block in blocks(pa.array([t for _, t in rows], pa.string())):
            starts, ends, bounds = block.words(ALNUM)
            words.append(block.spans(block.hashed(True), starts, ends))
            size.append(np.diff(bounds))
        flat = np.concatenate([*words, np.zeros(0, U64)])
        size = np.concatenate([*size, np.zeros(0, np.int64)])
        first, length = np.cumsum(size) - size, np.minimum(size, window)
        self.by_length = []
        for m in np.unique(length[length > 0]).tolist():
            own = np.flatnonzero(length == m)
            many = size[own] - m + 1
            start = np.repeat(first[own] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            key = np.zeros(len(start), U64)
            for j in range(m):
                key = mix(key + flat[start + j] + U64(j + 1))
            _, index, pattern = np.unique(key, return_index=True, return_inverse=True)
            item = np.repeat(number[own], many)
            pairs = np.unique(np.stack([pattern[item >= 0], item[item >= 0]]), axis=1)
            item_at = np.searchsorted(pairs[0], np.arange(len(index) + 1))
            self.by_length.append(Patterns(m, flat, start[index], item_at, pairs[1]))


CARRIED = pa.struct([("words", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string()))])


def _hits(tables, text: str, carried: str):
    """Adds to each text's hit words (a bitmap) and items those of one portion of the benchmark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            before = [x or {} for x in batch.column(names.index(carried)).to_pylist()]
            old, had = [x.get("hit") for x in before], [x.get("items") for x in before]
            count, hit, items = [0] * len(old), [None] * len(old), [None] * len(old)
            for block in blocks(batch.column(names.index(text)).cast(pa.string())):
                starts, ends, bounds = block.words(ALNUM)
                words = block.spans(block.hashed(True), starts, ends)
                pairs = _pairs(words)
                edge, told = np.zeros(len(words) + 1, np.int32), {}
                for t in tables.value.by_length:
                    p, pattern = t.search(words, pairs, bounds)
                    np.add.at(edge, p - t.m + 1, 1)
                    np.add.at(edge, p + 1, -1)
                    doc = np.searchsorted(bounds, p, "right") - 1
                    for d, k in set(zip(doc.tolist(), pattern.tolist())):
                        told.setdefault(d, set()).update(t.items(k).tolist())
                inside = np.cumsum(edge[:-1]) > 0
                for i, row in enumerate(block.rows):
                    count[row] = int(bounds[i + 1] - bounds[i])
                    if i in told:
                        now = inside[bounds[i] : bounds[i + 1]]
                        if old[row]:
                            now = now | np.unpackbits(np.frombuffer(old[row], np.uint8), count=len(now)).astype(bool)
                        hit[row], items[row] = np.packbits(now).tobytes(), sorted({str(tables.value.names[x]) for x in told[i]} | set(had[row] or ()))
                    else:
                        hit[row], items[row] = old[row], had[row]
            new = pa.array([{"words": c, "hit": h, "items": x} for c, h, x in zip(count, hit, items)], CARRIED)
            yield pa.record_batch([new if x == carried else batch.column(i) for i, x in enumerate(names)], names=names)

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The id column, and what the carried column says."""
    for batch in batches:
        ids, told = batch.column(0), batch.column(1).to_pylist()
        n = [int(np.unpackbits(np.frombuffer(x["hit"], np.uint8)).sum()) if x["hit"] else 0 for x in told]
        items = [x["items"] or [] for x in told]
        sha = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]
        yield pa.record_batch([ids, pa.array([x["words"] for x in told], pa.int64()), pa.array(n, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in n], pa.bool_()), pa.array(items, pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items"])


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, portion_bytes: int) -> tuple[DataFrame, str]:
    """``docs`` with a struct of words, hit and items, and that column's name, which no column of ``docs`` has."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    portions = 1 if total <= portion_bytes else math.ceil(2 * total / portion_bytes)
    carried = "_carried"
    while carried.lower() in {c.lower() for c in docs.columns}:
        carried += "_"
    out = docs.withColumn(carried, F.lit(None).cast("struct<words:bigint,hit:binary,items:array<string>>"))
    for k in range(portions):
        part = items if portions == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(portions)) == k)
        rows = [tuple(r) for r in part.toLocalIterator()]  # about half of portion_bytes
        out = out.mapInArrow(_hits(spark.sparkContext.broadcast(Tables(rows, window)), "text", carried), out.schema)
        if k + 1 < portions:
            out = cut(out)
    return out, carried


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_words, n_hit (words inside some benchmark window), n_items, items_sha256,
    contaminated and items, for the windows of ``window`` consecutive words of ``benchmark`` (item_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out, carried = _searched(docs.select("doc_id", F.col("text").cast("string").alias("text")), benchmark, window, portion_bytes)
    return out.select("doc_id", carried).mapInArrow(_summed, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, portion_bytes: int = PORTION_BYTES) -> DataFrame:
    """The documents in which no benchmark window occurs, with all columns."""
    out, carried = _searched(docs, benchmark, window, portion_bytes)
    return out.where(F.col(carried)["hit"].isNull()).drop(carried)
