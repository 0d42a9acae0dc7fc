"""Language-model scoring by Katz backoff over bigrams.

Tokens are words and one end per text; the first token follows a start. Counts are discounted by Good-Turing below a small
count, and what that leaves of a history's mass goes to the tokens not seen after it, in proportion to their own probability:

    p(w | h) = d(c) c(h, w) / N(h)        if h w was seen
             = alpha(h) p(w)              if not, alpha(h) 1 for a history never seen
    p(w)     = d(c) c(w) / N, and what is left is the probability of any unseen word

alpha(h) is (1 - sum of p(w | h)) / (1 - sum of p(w)) over the w seen after h, so each distribution sums to 1. If discounts
leave nothing, N + 1 takes the place of N.

``learn`` keeps the model as two tables in the shared folder: words and their counts, and the bigrams of each bucket, grouped
by history. A history is dealt to a bucket, a frequent one by its bigrams, whose sums are
added up; the number of frequent words, histories and bigrams is bounded (``WORDS``, ``HISTORIES``, ``BIGRAMS``), and so is what
is broadcast of them. ``score`` evaluates frequent words and bigrams where the text is read; all other tokens go to their bucket, meet the
model there, and come back as sums by document. Rare words' counts come to the buckets by a join.

Words and bigrams are told apart by 64-bit hashes. Null texts are empty (and have an end); repeated rows are learned from and
scored each; without training rows every text has probability 1; an empty table gives no rows; other columns are ignored. A task
holds one chunk of texts, or one very long text. Chunks are numbered as they are read, so ``docs`` must come from a table or a
checkpoint, which a repeated task reads alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import release, shared_folder, width
from .textblocks import NONSPACE, U64, blocks, mix

START, END = U64(0x5354415254), U64(0x454E44)
MOST_DISCOUNTED = 5
#: How many words, histories and bigrams are frequent at most.
WORDS, HISTORIES, BIGRAMS = 1 << 19, 1 << 14, 1 << 19
CHUNK_TOKENS = 400_000
BLOCK_BYTES = 1 << 19  # of text that is hashed at a time
CHUNK_DOCS = 60_000
BUCKET_TOKENS = 1_500_000
FLUSH = 1 << 19


def held_out(doc_id: Column, mod: int = 5, rest: int = 1) -> Column:
    """True where crc32 of the id as text leaves that rest; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % mod == rest


@dataclass
class Discounts:
    """d(c) of counts, the total they refer to, and for single tokens what is left to an unseen one and added to the total."""

    of: np.ndarray  # d(0), d(1) to d(k); 1 beyond
    total: int = 0
    unseen: float = 1.0
    extra: int = 0

    def __call__(self, c: np.ndarray) -> np.ndarray:
        return self.of[np.minimum(c, len(self.of) - 1)]


def good_turing(times: list[int]) -> np.ndarray:
    """d(0) to d(k), then 1, of how many kinds occur 1, 2, ... times (``MOST_DISCOUNTED`` + 1 numbers): Katz' discounts for the
    largest k that gives values within (0, 1); where none does, as in tiny or much repeated corpora, r / (r + 1)."""
    n = [0, *times]
    for k in range(MOST_DISCOUNTED, 1, -1):
        if not all(n[1 : k + 2]):
            continue
        tail = (k + 1) * n[k + 1] / n[1]
        if tail >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) for r in range(1, k + 1)]
        if all(0 < x < 1 for x in d):
            return np.array([1.0, *d, 1.0])
    return np.array([1.0, *(r / (r + 1) for r in range(1, MOST_DISCOUNTED + 1)), 1.0])


class Table:
    """Values of 64-bit keys, in numpy. Keys are hashes, so their leading bits lead to within a few places of each."""

    def __init__(self, keys: np.ndarray, **values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], {k: v[order] for k, v in values.items()}
        bits = max(1, len(keys).bit_length())
        self.down = U64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=U64) << self.down).astype(np.int32 if len(keys) < 2**31 else np.int64)
        self.first = np.append(self.first, len(keys)).astype(self.first.dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        lead = (keys >> self.down).astype(np.int64)
        at, end = self.first[lead], self.first[lead + 1]
        going = np.flatnonzero(at < end)
        while len(going):
            going = going[self.keys[at[going]] < keys[going]]
            at[going] += 1
            going = going[at[going] < end[going]]
        at = np.minimum(at, len(self.keys) - 1)
        return at, self.keys[at] == keys


class Words(Table):
    """The frequent words with their counts, and codes by rank for sending them: three bytes, mostly of the first two only."""

    OTHER = 0xFFFFFF

    def __init__(self, keys: np.ndarray, c: np.ndarray):
        order = np.argsort(-c, kind="stable")
        ranked = np.append(keys[order], START)  # a history, but no word
        super().__init__(ranked, c=np.append(c[order], 0), code=np.arange(len(ranked), dtype=np.uint32))
        self.place = np.empty(len(ranked), np.int32)  # of each code among the keys
        self.place[self.values["code"]] = np.arange(len(ranked), dtype=np.int32)

    def leading(self, n: int) -> np.ndarray:
        """The n most frequent words."""
        return self.keys[self.place[: min(n, len(self.place) - 1)]]

    def codes(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, counts, and which are frequent words."""
        at, there = self.find(keys)
        return np.where(there, self.values["code"][at], np.uint32(self.OTHER)), np.where(there, self.values["c"][at], 0), there

    def pack(self, keys: np.ndarray, code: np.ndarray) -> bytes:
        return len(keys).to_bytes(8, "little") + code.astype("<u2").tobytes() + (code >> 16).astype(np.uint8).tobytes() + keys[code == self.OTHER].tobytes()

    def unpack(self, data: bytes) -> np.ndarray:
        n = int.from_bytes(data[:8], "little")
        code = np.frombuffer(data, "<u2", n, 8).astype(np.uint32) | np.frombuffer(data, np.uint8, n, 8 + 2 * n).astype(np.uint32) << 16
        other = code == self.OTHER
        out = self.keys[self.place[np.where(other, 0, code)]]
        out[other] = np.frombuffer(data, U64, int(other.sum()), 8 + 3 * n)
        return out

    def column(self, table: pa.Table, name: str) -> np.ndarray:
        return np.concatenate([*map(self.unpack, table.column(name).to_pylist()), np.zeros(0, U64)])


def joint(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h) + w)


def _tokens(block) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a block's texts, and how many each has."""
    starts, ends, bounds = block.words(NONSPACE)
    words = block.spans(block.hashed(True), starts, ends)
    out = np.empty(len(words) + block.n, U64)
    at = bounds + np.arange(block.n + 1)
    is_end = np.zeros(len(out), bool)
    is_end[at[1:] - 1] = True
    out[is_end], out[~is_end] = END, words
    return out, np.diff(at)


def _chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row of the first, number of texts, tokens, bounds) of at most ``CHUNK_TOKENS`` in ``CHUNK_DOCS`` texts, or of one text."""
    kept, lo, docs, held = [], 0, 0, 0

    def out():
        return lo, docs, np.concatenate([t for t, _ in kept]), np.concatenate([[0], np.cumsum(np.concatenate([n for _, n in kept]))])

    for part in range(0, len(column), CHUNK_DOCS):
        for block in blocks(column.slice(part, CHUNK_DOCS), BLOCK_BYTES):
            tokens, n = _tokens(block)
            if kept and (held + len(tokens) > CHUNK_TOKENS or docs + block.n > CHUNK_DOCS):
                yield out()
                lo, kept, docs, held = lo + docs, [], 0, 0
            kept.append((tokens, n))
            docs += block.n
            held += len(tokens)
    if kept:
        yield out()


def _histories(tokens: np.ndarray, at: np.ndarray, start=START) -> np.ndarray:
    h = np.empty_like(tokens)
    h[1:] = tokens[:-1]
    h[at[:-1]] = start
    return h


def _freed(rows):
    """The same rows; what Arrow keeps for later goes back to the machine."""
    pa.default_memory_pool().release_unused()
    return rows


def _sums(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    k, n = np.unique(keys, return_counts=True)
    return k, n.astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept, held = [], 0

    def out() -> pa.RecordBatch:
        k = np.concatenate([a for a, _ in kept])
        n = np.concatenate([b for _, b in kept])
        u, at = np.unique(k, return_inverse=True)
        total = np.zeros(len(u), np.int64)
        np.add.at(total, at, n)
        return pa.record_batch([pa.array(u.view(np.int64)), pa.array(total)], names=["w", "c"])

    for batch in map(_freed, batches):
        for block in blocks(batch.column(0), BLOCK_BYTES):
            kept.append(_sums(_tokens(block)[0]))
            held += len(kept[-1][0])
            if held > FLUSH:
                yield out()
                kept, held = [], 0
    if kept:
        yield out()


class Dealer:
    """To which bucket a bigram goes: by its history, those of frequent histories by both."""

    def __init__(self, buckets: int, hot: np.ndarray):
        self.buckets, self.hot = buckets, Table(hot)

    def __call__(self, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hot = self.hot.find(h)[1]
        by = np.where(hot, joint(h, w), mix(h + U64(1)))
        return (by % U64(self.buckets)).astype(np.int32), hot


PAIRS = "bucket int, kind tinyint, h binary, w binary, c binary, w1 long, c1 long"
_PAIRS = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("h", pa.binary()), ("w", pa.binary()), ("c", pa.binary()), ("w1", pa.int64()), ("c1", pa.int64())])


def _by_bucket(bucket: np.ndarray, h: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order by bucket, then by the codes of history and word; and (bucket, from, to) in it."""
    order = np.argsort(h.astype(U64) << U64(24) | w)
    b = bucket[order]
    order = order[np.argsort(b.astype(np.int16) if len(b) and b.max() < 32768 else b, kind="stable")]
    b = bucket[order]
    edges = np.append(np.flatnonzero(np.append(True, b[1:] != b[:-1])), len(b)) if len(b) else np.zeros(1, np.int64)
    return order, [(int(b[x]), int(x), int(y)) for x, y in zip(edges[:-1], edges[1:])]


def _bigram_counts(known):
    """For each chunk and bucket, the bigrams and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, dealer = known.value.frequent, known.value.dealer
        for batch in map(_freed, batches):
            for _, _, tokens, at in _chunks(batch.column(0)):
                h = _histories(tokens, at)
                key = joint(h, tokens)
                order = np.argsort(key)
                key = key[order]
                first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
                c = np.diff(np.append(first, len(key))).astype(np.uint32)
                h, w = h[order[first]], tokens[order[first]]
                hc, wc = words.codes(h)[0], words.codes(w)[0]
                order, parts = _by_bucket(dealer(h, w)[0], hc, wc)
                h, w, c, hc, wc = h[order], w[order], c[order], hc[order], wc[order]
                rows = [(b, 0, words.pack(h[x:y], hc[x:y]), words.pack(w[x:y], wc[x:y]), c[x:y].tobytes(), None, None) for b, x, y in parts]
                yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows), _PAIRS)], schema=_PAIRS)

    return run


def _rare_words(known):
    """(bucket, w): the words that are not frequent and the buckets where they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in map(_freed, batches):
            for _, _, tokens, at in _chunks(batch.column(0)):
                rare = ~known.value.frequent.find(tokens)[1]
                w = tokens[rare]
                b, _ = known.value.dealer(_histories(tokens, at)[rare], w)
                _, first = np.unique(mix(w) + b.astype(U64), return_index=True)
                yield pa.record_batch([pa.array(b[first]), pa.array(w[first].view(np.int64))], names=["bucket", "w"])

    return run


def _column(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _of_kind(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table.column("kind").to_numpy() == kind))


class Chances:
    """Probabilities of single tokens by their counts."""

    def __init__(self, discounts: Discounts, frequent: Table, rare: Table | None = None):
        self.d, self.frequent, self.rare = discounts, frequent, rare

    def counts(self, w: np.ndarray) -> np.ndarray:
        out = np.zeros(len(w), np.int64)
        for table in (self.rare, self.frequent):
            if table is not None and len(table.keys):
                at, there = table.find(w)
                out[there] = table.values["c"][at[there]]
        return out

    def p(self, c: np.ndarray) -> np.ndarray:
        """Of tokens that occur c times."""
        total = self.d.total
        if not total:
            return np.ones(len(c))
        return np.where(c > 0, self.d(c) * c / (total + self.d.extra), self.d.unseen)


def _rare_table(table: pa.Table) -> Table:
    told = _of_kind(table, 2)
    return Table(told.column("w1").to_numpy().view(U64), c=told.column("c1").to_numpy())


MODEL = "bucket int, kind tinyint, h binary, w binary, c binary, size binary, unseen binary, times array<long>, hot array<struct<h:long,p:double,n:long,times:array<long>>>"
_HOT = pa.list_(pa.struct([("h", pa.int64()), ("p", pa.float64()), ("n", pa.int64()), ("times", pa.list_(pa.int64()))]))
_MODEL = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), *((c, pa.binary()) for c in ("h", "w", "c", "size", "unseen")), ("times", pa.list_(pa.int64())), ("hot", _HOT)])


def _merged(known, single_discounts: Discounts):
    """One row a bucket: its histories, how many words follow each, 1 - the sum of those words' own probabilities, the words and
    their counts; how many bigrams occur 1, 2, ... times; and of frequent histories the sums of this bucket."""
    k = MOST_DISCOUNTED

    def run(table: pa.Table) -> pa.Table:
        _freed(None)
        if not table.num_rows:
            return _MODEL.empty_table()
        rows = _of_kind(table, 0)
        if not rows.num_rows:
            return _MODEL.empty_table()
        words = known.value.frequent
        h, w, c = words.column(rows, "h"), words.column(rows, "w"), _column(rows, "c", np.uint32).astype(np.int64)
        key = joint(h, w)
        order = np.argsort(key)
        key, h, w, c = key[order], h[order], w[order], c[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        h, w, c = h[first], w[first], np.add.reduceat(c, first)
        hc, wc = words.codes(h)[0], words.codes(w)[0]
        order = np.lexsort((wc, h, hc))
        h, w, c, hc, wc = h[order], w[order], c[order], hc[order], wc[order]
        single = Chances(single_discounts, words, _rare_table(table))
        p = single.p(single.counts(w))
        start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
        size = np.diff(np.append(start, len(h)))
        seen = np.add.reduceat(p, start)
        hot = known.value.dealer.hot.find(h[start])[1]
        few = np.where(c <= k, c, 0)
        each = [np.add.reduceat((few == r).astype(np.int64), start) for r in range(1, k + 1)]
        total = np.add.reduceat(c, start)
        told = [{"h": int(h[s].view(np.int64)), "p": float(seen[i]), "n": int(total[i]), "times": [int(e[i]) for e in each]} for i, s in enumerate(start.tolist()) if hot[i]]
        times = [int((c == r).sum()) for r in range(1, k + 2)]
        bucket = rows.column("bucket")[0].as_py()
        values = [bucket, 1, words.pack(h[start], hc[start]), words.pack(w, wc), c.tobytes(), size.astype(np.uint32).tobytes(), (1 - seen).tobytes(), times, told]
        return pa.Table.from_arrays([pa.array([v], t.type) for v, t in zip(values, _MODEL)], schema=_MODEL)

    return run


@dataclass
class Known:
    """What the buckets of a model in the making are dealt by, and its frequent words."""

    dealer: Dealer
    frequent: Words


@dataclass
class Model:
    """The tables' paths, and what is broadcast: discounts, totals, frequent words, histories and bigrams."""

    words: str
    pairs: str
    n: int
    v: int
    single: Discounts
    double: Discounts
    frequent: Words
    dealer: Dealer
    hot: Table  # of frequent histories: log of what divides counts, log of alpha
    often: Table  # of frequent bigrams: log of their probability


def _opened(known):
    """(h, w, c) of the bigrams of frequent histories that occur often enough for ``least``."""

    def of(least: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for h, size, w, c in zip(*(batch.column(i).to_pylist() for i in range(4))):
                    h, size, w, c = known.value.frequent.unpack(h), np.frombuffer(size, np.uint32), known.value.frequent.unpack(w), np.frombuffer(c, np.int64)
                    own = np.flatnonzero(np.repeat(known.value.dealer.hot.find(h)[1], size) & (c >= least))
                    yield pa.record_batch([pa.array(np.repeat(h, size)[own].view(np.int64)), pa.array(w[own].view(np.int64)), pa.array(c[own])], names=["h", "w", "c"])

        return run

    return of


def _most_frequent(df: DataFrame, most: int) -> DataFrame:
    """The rows of ``df`` (c) with the largest counts, ``most`` at most; counts of one eighth of a power of two stay together."""
    level = F.floor(F.log2("c") * 8)
    held, least = 0, 64 * 8
    for x, n in sorted(df.groupBy(level.alias("x")).count().collect(), reverse=True):
        held += n
        if held > most:
            break
        least = x
    return df.where(level >= least)


def _arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.toArrow()
    return [got.column(c).to_numpy() for c in names]


def learn(docs: DataFrame) -> Model:
    """Learns from all rows of ``docs`` (text) into tables under the shared folder."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/katz-{uuid.uuid4().hex}"
    texts = docs.select(F.col("text").cast("string").alias("text"))
    texts.mapInArrow(_word_counts, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).write.parquet(f"{folder}/words")
    words = spark.read.parquet(f"{folder}/words")
    few = range(1, MOST_DISCOUNTED + 2)
    got = words.agg(F.sum("c"), F.count("*"), *(F.count(F.when(F.col("c") == r, 1)) for r in few), F.max(F.when(F.col("w") == int(END.view(np.int64)), F.col("c")))).first()
    n, v, starts = got[0] or 0, got[1], got[-1] or 0
    single = _left(Discounts(good_turing(list(got[2:-1])), n), dict(zip(few, got[2:-1])), n)
    w, c = _arrays(_most_frequent(words, WORDS), "w", "c")
    frequent = Words(w.view(U64), c)
    own = frequent.leading(HISTORIES)
    dealer = Dealer(max(width(spark), -(-n // BUCKET_TOKENS)), np.append(own[own != END], START))
    known = spark.sparkContext.broadcast(Known(dealer, frequent))
    rows = texts.mapInArrow(_bigram_counts(known), PAIRS)
    needs = _answers(texts, known, words, PAIRS)
    merged = rows.union(needs).groupBy("bucket").applyInArrow(_merged(known, single), MODEL)
    merged.write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    times = [x or 0 for x in pairs.agg(*(F.sum(F.col("times")[r - 1]) for r in few)).first()]
    double = Discounts(good_turing(times), n)
    each = pairs.select(F.explode("hot").alias("x")).groupBy("x.h").agg(F.sum("x.p").alias("p"), F.sum("x.n").alias("n"), *(F.sum(F.col("x.times")[r - 1]).alias(f"n{r}") for r in range(1, MOST_DISCOUNTED + 1)))
    h, p, total, *of = _arrays(each, "h", "p", "n", *(f"n{r}" for r in range(1, MOST_DISCOUNTED + 1)))
    lost = sum((1 - double.of[min(r, len(double.of) - 1)]) * r * x for r, x in enumerate(of, 1)) if len(h) else np.zeros(0)
    below, alpha = _divided(total, lost, 1 - p)
    hot_table = Table(h.view(U64), below=below, alpha=alpha)
    opened = lambda least: pairs.select("h", "size", "w", "c").mapInArrow(_opened(known)(least), "h long, w long, c long")
    some = max(2, n // (4 * BIGRAMS))  # at most four times as many bigrams occur so often
    x, y, c = _arrays(_most_frequent(opened(some), BIGRAMS), "h", "w", "c")
    at, _ = hot_table.find(x.view(U64))
    often = Table(joint(x.view(U64), y.view(U64)), p=np.log10(double(c) * c) - hot_table.values["below"][at] if len(x) else np.zeros(0))
    known.destroy()  # a worker keeps what was broadcast to it
    return Model(f"{folder}/words", f"{folder}/pairs", n, v, single, double, frequent, dealer, hot_table, often)


def _left(d: Discounts, times: dict[int, int], n: int) -> Discounts:
    """Adds what discounts leave to unseen tokens, and what is added to the total if that is nothing."""
    lost = sum((1 - d.of[min(r, len(d.of) - 1)]) * r * x for r, x in times.items())
    d.extra = 0 if lost > 0 else 1
    d.unseen = (lost or 1) / (n + d.extra) if n else 1.0
    return d


def _divided(total: np.ndarray, lost: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logs of what divides a history's counts and of its backoff weight, by its total count, the counts that discounts take
    away, and the probability of the words not seen after it."""
    none = lost <= 0
    below = total + none
    return np.log10(np.maximum(below, 1)), np.log10(np.where(none, 1.0, lost) / np.maximum(below, 1) / unseen)


def _answers(texts: DataFrame, known, words: DataFrame, kind: str) -> DataFrame:
    """Counts of the words that are not frequent, for each bucket where they stand, as rows of the columns ``kind``."""
    needs = texts.mapInArrow(_rare_words(known), "bucket int, w long").distinct()
    told = needs.join(words, "w").select("bucket", F.lit(2).cast("tinyint").alias("kind"), F.col("w").alias("w1"), F.col("c").alias("c1"))
    have = set(told.columns)
    return told.select(*(F.col(c.split(" ")[0]) if c.split(" ")[0] in have else F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in kind.split(", ")))


TILES = "bucket int, kind tinyint, chunk long, h binary, w binary, d binary, tokens binary, known binary, base binary, score binary, size binary, c binary, unseen binary, w1 long, c1 long"
_NAMES = [(c.split(" ")[0], {"int": pa.int32(), "tinyint": pa.int8(), "long": pa.int64(), "binary": pa.binary()}[c.split(" ")[1]]) for c in TILES.split(", ")]


def _tile(**values) -> list:
    return [values.get(c) for c, _ in _NAMES]


def _base(model, c: np.ndarray) -> np.ndarray:
    return np.log10((c + 0.5) / (model.n + 0.5 * (model.v + 1)))


def _tiles(model):
    """Per chunk a row (kind 0) of the documents' ids and what is known at once; and for each bucket (kind 3) the bigrams to be
    evaluated there, with their documents' numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        dealer, words = m.dealer, m.frequent
        number = TaskContext.get().partitionId() << 32
        for batch in map(_freed, batches):
            ids = batch.column(0)
            for lo, n, tokens, at in _chunks(batch.column(1)):
                wc, c, there = words.codes(tokens)
                h, hc = _histories(tokens, at), _histories(wc, at, len(words.keys) - 1)
                doc = np.repeat(np.arange(n), np.diff(at))
                base = np.bincount(doc[there], _base(m, c[there]), n)
                known = np.bincount(doc[there], minlength=n)
                place, done = m.often.find(joint(h, tokens))
                score = np.bincount(doc[done], m.often.values["p"][place[done]] if done.any() else None, n).astype(float)
                rows = [_tile(bucket=number % dealer.buckets, kind=0, chunk=number, tokens=np.diff(at).tobytes(), known=known.astype(np.int64).tobytes(), base=base.astype(float).tobytes(), score=score.tobytes())]
                rest = np.flatnonzero(~done)
                order, parts = _by_bucket(dealer(h[rest], tokens[rest])[0], hc[rest], wc[rest])
                rest = rest[order]
                for b, x, y in parts:
                    own = rest[x:y]
                    rows.append(_tile(bucket=b, kind=3, chunk=number, d=doc[own].astype(np.uint16).tobytes(), h=words.pack(h[own], hc[own]), w=words.pack(tokens[own], wc[own])))
                lists = pa.array([ids.slice(lo, n).to_pylist(), *[None] * (len(rows) - 1)], pa.list_(ids.type))
                yield pa.record_batch([*(pa.array(x, t) for x, (_, t) in zip(zip(*rows), _NAMES)), lists], names=[*(c for c, _ in _NAMES), "ids"])
                number += 1

    return run


def _evaluated(model, kind: pa.DataType):
    """Of one bucket: the sums by chunk and document of what its bigrams score (kind 1); rows of kind 0 go through."""
    schema = pa.schema([("chunk", pa.int64()), ("d", pa.binary()), *((c, pa.binary()) for c in ("tokens", "known", "base", "score")), ("ids", pa.list_(kind))])

    def run(table: pa.Table) -> pa.Table:
        _freed(None)
        m = model.value
        out = [tuple(x[c] for c in schema.names) for x in _of_kind(table, 0).select(schema.names).to_pylist()]
        tiles = _of_kind(table, 3)
        if tiles.num_rows:
            single = Chances(m.single, m.frequent, _rare_table(table))
            own = _of_kind(table, 1)
            heads, w, c = m.frequent.column(own, "h"), m.frequent.column(own, "w"), _column(own, "c", np.int64)
            size, unseen = _column(own, "size", np.uint32).astype(np.int64), _column(own, "unseen", np.float64)
            start = np.cumsum(size) - size
            total = np.add.reduceat(c, start) if len(c) else c
            lost = np.add.reduceat((1 - m.double(c)) * c, start) if len(c) else np.zeros(0)
            below, alpha = _divided(total, lost, unseen)  # of frequent histories a part only, so their own follow
            at, hot = m.hot.find(heads)
            below[hot] = m.hot.values["below"][at[hot]]
            heads_table = Table(heads, alpha=alpha)
            pairs = Table(joint(np.repeat(heads, size), w), p=np.log10(m.double(c) * c) - np.repeat(below, size))
            for row in range(tiles.num_rows):
                tile = tiles.slice(row, 1)
                h, w, d = m.frequent.column(tile, "h"), m.frequent.column(tile, "w"), _column(tile, "d", np.uint16)
                docs, at = np.unique(d, return_inverse=True)
                known = base = None
                place, seen = pairs.find(joint(h, w))
                value = np.empty(len(w))
                value[seen] = pairs.values["p"][place[seen]]
                new = np.flatnonzero(~seen)
                value[new] = np.log10(single.p(single.counts(w[new])))
                for table in (m.hot, heads_table):  # those of frequent histories are the same in both
                    own, met = table.find(h[new])
                    value[new[met]] += table.values["alpha"][own[met]]
                    new = new[~met]
                rare = np.flatnonzero(~m.frequent.find(w)[1])
                if len(rare):
                    c1 = single.counts(w[rare])
                    known = np.bincount(at[rare], (c1 > 0).astype(float), len(docs)).astype(np.int64).tobytes()
                    base = np.bincount(at[rare], _base(m, c1), len(docs)).tobytes()
                out.append((tile.column("chunk")[0].as_py(), docs.tobytes(), None, known, base, np.bincount(at, value, len(docs)).tobytes(), None))
        if not out:
            return schema.empty_table()
        return pa.Table.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), schema)], schema=schema)

    return run


def _added(train: int, kind: pa.DataType):
    """The rows of a chunk's documents from all its buckets' sums."""
    schema = pa.schema([("doc_id", kind), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = [x for x in rows if x["ids"] is not None]
        if not own:
            return schema.empty_table()
        ids = own[0]["ids"]
        tokens, known = np.frombuffer(own[0]["tokens"], np.int64), np.frombuffer(own[0]["known"], np.int64).copy()
        base, score = np.frombuffer(own[0]["base"]).copy(), np.frombuffer(own[0]["score"]).copy()
        for x in sorted((x for x in rows if x["ids"] is None), key=lambda x: (x["d"], x["score"])):
            d = np.frombuffer(x["d"], np.uint16)
            score[d] += np.frombuffer(x["score"])
            if x["base"] is not None:
                known[d] += np.frombuffer(x["known"], np.int64)
                base[d] += np.frombuffer(x["base"])
        return pa.Table.from_arrays([pa.array(ids, kind), pa.array(tokens), pa.array(known), pa.array(np.full(len(tokens), train, np.int64)), pa.array(base), pa.array(score)], schema=schema)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known (tokens that were learned from), train_tokens, base_score (log10
    of smoothed single counts) and score (log10 of the model's probability of the text)."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    arrow = docs.select("doc_id").limit(0).toArrow().schema.field(0).type
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    release(spark)  # of what learning has shuffled
    whole = spark.sparkContext.broadcast(model)
    told = f"{TILES}, ids array<{kind}>"
    tiles = rows.mapInArrow(_tiles(whole), told)
    answers = _answers(rows.select("text"), whole, spark.read.parquet(model.words), TILES)
    pairs = spark.read.parquet(model.pairs)
    have = set(pairs.columns) & {c for c, _ in _NAMES}
    pairs = pairs.select(*(F.col(c.split(" ")[0]) if c.split(" ")[0] in have else F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0]) for c in TILES.split(", ")))
    none = F.lit(None).cast(f"array<{kind}>").alias("ids")
    every = tiles.union(answers.select("*", none)).union(pairs.select("*", none))
    sums = every.groupBy("bucket").applyInArrow(_evaluated(whole, arrow), f"chunk long, d binary, tokens binary, known binary, base binary, score binary, ids array<{kind}>")
    return sums.groupBy("chunk").applyInArrow(_added(model.n, arrow), f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
