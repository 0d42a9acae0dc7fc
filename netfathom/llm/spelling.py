"""Spelling variants by reduced alphabets: words one edit apart, and the frequent form that each rare word stands for.

Letters are hashed to a few symbols. Of every reduced word the full one-edit neighbourhood is generated (itself, all
deletions, replacements and insertions of symbols) as 64-bit keys; a bitmap of the keys of the reduced vocabulary drops those
that no word has, and the rest meet the reduced vocabulary in an equality join. Two words one edit apart have reduced forms
at most one edit apart, so no pair is lost; pairs that are near only as reduced words go by the edit distance of the words
themselves. The number of symbols grows with the vocabulary (``symbols``), so that few words share a key.

Null texts have no words, a null id counts as an empty one, repeated rows count each time, an empty table gives no rows, and
other columns are ignored. Memory of a task is bounded by its longest document; a word's neighbourhood is made symbol by
symbol, in time linear in its length. Ties between forms go to the smallest word in code-point order.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import U64, mix, powers

#: letters A-Z, a-z and U+00C0 to U+00FF, as UTF-8
RUN = r"(?:[A-Za-z]|\xC3[\x80-\xBF]){%d,}"
LEAST_LETTERS, LEAST_COUNT, DOMINATES, SLIPS = 7, 2, 10, 31
FLUSH = 400_000
#: The bitmap has 2**BITS places at most; beyond, it drops less and the join still decides.
BITS = 28
BUCKET = 32768  # places in one bitmap of Spark's bitmap functions


def _counts(least: int):
    """(word, n) of the words of documents, summed as far as the task's memory goes."""
    runs = re.compile(RUN.encode() % least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(list(total), pa.binary()).cast(pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
            total.clear()
            return made

        for batch in batches:
            for key, text in zip(batch.column(0).cast(pa.binary()), batch.column(1).cast(pa.binary())):
                data = text.as_py()
                if not data:
                    continue
                begun = zlib.crc32((key.as_py() or b"") + b":")
                for word, n in Counter(runs.findall(data.lower())).items():
                    h = zlib.crc32(word, begun)
                    if h % SLIPS == 0:
                        letters = word.decode()
                        at = h % len(letters)
                        word = (letters[:at] + letters[at + 1 :]).encode()
                    total[word] += n
                if len(total) > FLUSH:
                    yield out()
        if total:
            yield out()

    return run


def vocabulary(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): words of at least so many code points that occur so often in ``docs`` (doc_id, text). A run of letters whose
    checksum with the document's id is divisible by 31 loses one letter before it is counted, as the contract says."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counts(least_letters), "word string, n long")
    return runs.groupBy("word").agg(F.sum("n").alias("n")).where((F.char_length("word") >= least_letters) & (F.col("n") >= least_count))


def symbols(words: int) -> int:
    """The least number of symbols by which the shortest words have as many reduced forms as there are words."""
    return next((a for a in (4, 8, 16) if a**LEAST_LETTERS >= words), 32)


class Reduced:
    """Reduced forms of a batch of words: flat symbols from 1 on, their place in the word, and running hashes."""

    def __init__(self, words: pa.Array, a: int):
        points = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), np.uint32)
        size = np.array([len(w) for w in words.to_pylist()], np.int64)
        self.n, self.a, self.size = len(size), a, size
        self.first = np.cumsum(size) - size
        self.word = np.repeat(np.arange(self.n), size)
        self.place = np.arange(len(points)) - np.repeat(self.first, size)
        self.symbol = mix(points.astype(U64) + U64(77)) % U64(a) + U64(1)
        self.power, inverse = powers(int(size.max(initial=0)) + 2)
        self.back = inverse[1]
        own = self.symbol * self.power[self.place]
        upto = np.concatenate([np.zeros(1, U64), np.cumsum(own, dtype=U64)])
        self.before = upto[:-1] - np.repeat(upto[self.first], size)  # hash of what stands before each letter
        self.through = self.before + own
        self.whole = upto[self.first + size] - upto[self.first]

    def key(self, h: np.ndarray, size: np.ndarray) -> np.ndarray:
        return mix(h + mix(size.astype(U64) + U64(1)))

    def keys(self) -> np.ndarray:
        return self.key(self.whole, self.size)

    def neighbours(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of the word, key) of all reduced words at most one edit away, some of them repeatedly."""
        all_, size, whole = np.arange(self.n), self.size[self.word], self.whole[self.word]
        yield all_, self.keys()
        yield self.word, self.key(self.before + (whole - self.through) * self.back, size - 1)
        for c in range(1, self.a + 1):
            c = U64(c)
            other = self.symbol != c
            at = self.power[self.place]
            yield self.word[other], self.key(whole + (c - self.symbol) * at, size)[other]
            yield self.word, self.key(self.before + c * at + (whole - self.before) * self.power[1], size + 1)
            yield all_, self.key(self.whole + c * self.power[self.size], self.size + 1)


def _reduced(a: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = Reduced(batch.column(0), a).keys().view(np.int64)
            yield pa.record_batch([pa.array(key), *batch.columns], names=["key", "near", "near_n"])

    return run


def _around(a: int, bits: int, places):
    """(key, word): the neighbourhoods of words, of which ``places`` holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.frombuffer(places.value, np.uint8)
        for batch in batches:
            word, key = [], []
            for w, k in Reduced(batch.column(0), a).neighbours():
                at = (k & U64((1 << bits) - 1)).view(np.int64)
                held = (there[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0
                word.append(w[held])
                key.append(k[held])
            w, k = np.concatenate(word), np.concatenate(key)
            order = np.lexsort((k, w))
            w, k = w[order], k[order]
            new = np.ones(len(w), bool)
            new[1:] = (w[1:] != w[:-1]) | (k[1:] != k[:-1])
            yield pa.record_batch([pa.array(k[new].view(np.int64)), batch.column(0).take(pa.array(w[new]))], names=["key", "word"])

    return run


def _places(keys: DataFrame, bits: int) -> bytes:
    """The bitmap of keys, 2**bits places of it, built by Spark and joined here."""
    low = F.col("key").bitwiseAND((1 << bits) - 1)
    parts = keys.select((F.shiftright(low, 15)).alias("b"), low.bitwiseAND(BUCKET - 1).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("m"))
    out = bytearray((1 << bits) // 8)
    for b, m in parts.toLocalIterator():
        out[b * BUCKET // 8 : b * BUCKET // 8 + len(m)] = m
    return bytes(out)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all pairs of ``words`` (word, n) exactly one edit apart, in both directions."""
    spark = words.sparkSession
    n = words.count()
    a = symbols(n)
    bits = min(BITS, max(20, n.bit_length() + 5))
    own = words.select("word", "n").mapInArrow(_reduced(a), "key long, near string, near_n long")
    places = spark.sparkContext.broadcast(_places(own, bits))
    around = words.select("word").mapInArrow(_around(a, bits, places), "key long, word string")
    met = around.join(own, "key").where("word <> near and abs(char_length(word) - char_length(near)) <= 1")
    # distinct neighbours may lead to one word only if keys collide; the pair is still told once
    return met.where(F.levenshtein("word", "near", 1) == 1).select("word", "near", "near_n").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form), following forms to their end. Each form occurs ten times as often as its word,
    so chains have 19 steps at most, and five doublings reach their end."""
    at = forms.select("word", F.col("form").alias("root"))
    for _ in range(5):
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        at = cut(at.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return at


def spelling_variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, dominates: int = DOMINATES) -> DataFrame:
    """Per word of ``docs`` (doc_id, text): word, form, root, n, n_near, form_n. The form is the near word of largest n, if that
    is at least ``dominates`` times the word's; the root is where following forms ends."""
    words = cut(vocabulary(docs, least_letters, least_count))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("least"), F.col("near"))).alias("best"))
    found = words.join(near, "word", "left")
    good = -F.col("best.least") >= dominates * F.col("n")
    found = cut(found.select("word", F.when(good, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, -F.col("best.least")).alias("form_n")))
    ends = roots(found.where("form is not null"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
