"""Language identification: scripts narrow the candidates, and Viterbi labels spans of mixed texts.

Learned from labelled texts: per language, how often each hashed character trigram of lower-cased words occurs, and in which
scripts its words are written. A word's score for a language is the sum of its trigrams' log probabilities; languages not
seen in a word's script are no candidates for it unless none is. Viterbi over a document's words, with a cost for each
switch of language, gives each word one label, and so spans. The document's language is the one with most characters of
words with letters, and the score is its share of them.

Counts are summed over all labelled texts in tables of fixed size (``BITS``), so what is gathered does not grow. A null
text, or one without letters, is ``und`` with score 0. Without labelled texts every text is ``und``. Ties go to the first
language in order. Null labels are not learned from; repeated rows count each time; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import width
from .textblocks import FOLD_BYTES, NONSPACE, blocks

BITS = 14
SWITCH = 12.0
#: Scripts by ranges of code points (fixed values); letters outside of them are "other".
SCRIPTS = {"latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF)], "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x77F)], "devanagari": [(0x900, 0x97F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)]}
_NAMES = [*SCRIPTS, "other"]
_tables: list[np.ndarray] = []


def _script_table() -> np.ndarray:
    """Script of each code point, from 1; 0: no letter."""
    if not _tables:
        out = np.zeros(0x110000, np.uint8)
        letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        out[letters] = len(_NAMES)
        for k, ranges in enumerate(SCRIPTS.values()):
            for a, b in ranges:
                out[a : b + 1][letters[a : b + 1]] = k + 1
        _tables.append(out)
    return _tables[0]


def _features(block) -> tuple[np.ndarray, ...]:
    """Words' bounds in bytes, documents' bounds in words, the trigram that ends at each byte, letters of each word and
    each word's script (of its first letter)."""
    data = FOLD_BYTES[block.data]
    starts, ends, bounds = block.words(NONSPACE)
    x = data.astype(np.uint32)
    one, two = np.r_[np.zeros(1, np.uint32), x[:-1]][: len(x)], np.r_[np.zeros(2, np.uint32), x[:-2]][: len(x)]
    one[starts] = two[starts] = 0  # a word's trigrams don't reach into what stands before it
    second = starts[ends - starts > 1] + 1
    two[second] = 0
    tri = x * 0x9E3779B1 + one * 0x85EBCA6B + two * 0xC2B2AE35
    tri = ((tri ^ (tri >> 15)) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS)
    lead = (block.data & 0xC0) != 0x80
    points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    script = _script_table()[points]
    letter = np.zeros(len(data) + 1, np.int32)
    of = np.zeros(len(data), np.uint8)
    of[lead] = script
    np.cumsum(of > 0, out=letter[1:])
    where = np.flatnonzero(of)
    first = np.searchsorted(where, starts)
    kind = np.zeros(len(starts), np.uint8)
    has = letter[ends] > letter[starts]
    kind[has] = of[where[first[has]]]
    return starts, ends, bounds, tri, letter[ends] - letter[starts], kind


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's trigram and script counts of each language."""
    size = 1 << BITS
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        for block in blocks(batch.column(0)):
            starts, ends, bounds, tri, letters, kind = _features(block)
            doc = np.repeat(np.arange(block.n), np.diff(bounds))
            good = letters > 0
            lens = ends - starts
            names = [langs[r] for r in block.rows]
            for lang in set(names):
                own = good & np.array([x == lang for x in names])[doc]
                to = counts.setdefault(lang, np.zeros(size + len(_NAMES) + 1, np.int64))
                n = lens[own]
                flat = np.repeat(starts[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                to[:size] += np.bincount(tri[flat], minlength=size)
                to[size:] += np.bincount(kind[own], minlength=len(_NAMES) + 1)
    rows = [(lang, i, int(v[i])) for lang, v in counts.items() for i in np.flatnonzero(v)]
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "slot", "n"])


class Model:
    def __init__(self, rows: list[tuple[str, int, int]]):
        size = 1 << BITS
        self.langs = sorted({r[0] for r in rows})
        counts = np.zeros((len(self.langs), size + len(_NAMES) + 1))
        at = {x: i for i, x in enumerate(self.langs)}
        for lang, slot, n in rows:
            counts[at[lang], slot] += n
        tri, scripts = counts[:, :size], counts[:, size:]
        self.log = np.log((tri + 0.5) / (tri.sum(1, keepdims=True) + 0.5 * size)).astype(np.float32)
        if self.langs:
            self.log -= self.log.mean(0, keepdims=True)
        #: languages seen in each script, in a hundredth of their words or more
        self.seen = (scripts >= 0.01 * np.maximum(1, scripts.sum(1, keepdims=True))).T
        self.seen[~self.seen.any(1)] = True


def viterbi(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """The best label of each word: scores of the labels on its path less ``switch`` for each change. All documents of a
    block advance together, the longest first."""
    total, k = scores.shape
    label = np.zeros(total, np.int16)
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if k == 1 or not len(order):
        return label
    first, n = bounds[:-1][order], n[order]
    live = np.searchsorted(-n, -np.arange(n[0]), "left")  # documents with more than t words
    back = np.zeros((total, k), np.int16)
    own = np.arange(k, dtype=np.int16)
    now = scores[first].copy()
    for t in range(1, int(n[0])):
        m = live[t]
        before = now[:m]
        best = before.argmax(1).astype(np.int16)
        top = before[np.arange(m), best][:, None] - switch
        stay = before >= top
        back[first[:m] + t] = np.where(stay, own, best[:, None])
        now[:m] = np.where(stay, before, top) + scores[first[:m] + t]
    state = now.argmax(1).astype(np.int16)
    for t in range(int(n[0]) - 1, -1, -1):
        m = live[t] if t else len(n)
        label[first[:m] + t] = state[:m]
        state[:m] = back[first[:m] + t, state[:m]]
    return label


def label_words(scores: np.ndarray, bounds: np.ndarray, switch: float) -> np.ndarray:
    """As ``viterbi``, which runs only where it can find more than one label: if no stretch of words is better by more
    than half a switch in another language than in the one with the best sum, every path with switches is worse."""
    total, k = scores.shape
    n = np.diff(bounds)
    doc = np.repeat(np.arange(len(n)), n)
    sums = np.zeros((total + 1, k))
    np.cumsum(scores, axis=0, out=sums[1:])
    best = (sums[bounds[1:]] - sums[bounds[:-1]]).argmax(1)
    label = best[doc].astype(np.int16)
    mixed = np.zeros(len(n), bool)
    own = np.take_along_axis(scores, best[doc][:, None], 1)[:, 0] if total else np.zeros(0)
    start = bounds[:-1][n > 0]
    down = doc * 1e7  # so that a running minimum starts anew with each document
    for j in range(k if total else 0):
        gain = np.r_[0.0, np.cumsum(scores[:, j] - own, dtype=np.float64)]
        low = np.minimum.accumulate(gain[:-1] - down) + down
        mixed[n > 0] |= np.maximum.reduceat(gain[1:] - low, start) > switch / 2
    if mixed.any():
        some = mixed[doc]
        label[some] = viterbi(scores[some], np.r_[0, np.cumsum(n[mixed])], switch)
    return label


def _predict(model, switch: float, with_spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            langs, score, spans = [], [], []
            for block in blocks(batch.column(1)):
                starts, ends, bounds, tri, letters, kind = _features(block)
                if not m.langs:
                    langs += ["und"] * block.n
                    score += [0.0] * block.n
                    spans += [[]] * block.n
                    continue
                words = np.zeros((len(starts), len(m.langs)), np.float32)
                for j in range(len(m.langs)):
                    sums = np.r_[0.0, np.cumsum(m.log[j][tri], dtype=np.float64)]
                    words[:, j] = sums[ends] - sums[starts]
                words[letters == 0] = 0
                words -= words.max(1, keepdims=True, initial=-np.inf)
                words[~m.seen[kind] & (kind > 0)[:, None]] = -1e4
                label = label_words(words, bounds, switch)
                doc = np.repeat(np.arange(block.n), np.diff(bounds))
                share = np.bincount(doc * len(m.langs) + label, weights=letters, minlength=block.n * len(m.langs)).reshape(block.n, -1)
                best, all_ = share.argmax(1), share.sum(1)
                langs += ["und" if not a else m.langs[b] for a, b in zip(all_, best)]
                score += (share.max(1) / np.maximum(1, all_)).tolist()
                if with_spans:
                    for i in range(block.n):
                        own = label[bounds[i] : bounds[i + 1]]
                        cuts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if len(own) else own
                        spans.append([{"first_word": int(a), "words": int(b - a), "lang": m.langs[own[a]]} for a, b in zip(cuts, np.r_[cuts[1:], len(own)])])
            columns = [*(batch.column(i) for i in range(batch.num_columns) if i != 1), pa.array(langs, pa.string()), pa.array(score, pa.float64())]
            names = [x for i, x in enumerate(batch.schema.names) if i != 1] + ["lang_pred", "score"]
            if with_spans:
                columns.append(pa.array(spans, pa.list_(pa.struct([("first_word", pa.int64()), ("words", pa.int64()), ("lang", pa.string())]))))
                names.append("spans")
            yield pa.record_batch(columns, names=names)

    return run


def learn(labelled: DataFrame) -> Model:
    """From (text, lang); all rows count. What comes to the driver is languages times 2 ** BITS numbers."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), "lang").where("text is not null and lang is not null").mapInArrow(_learn, "lang string, slot int, n long")
    summed = rows.repartition(width(labelled.sparkSession), "lang", "slot").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    return Model([tuple(r) for r in summed.collect()])


def held_out(doc_id: Column) -> Column:
    """Whether a document is held out; one without an id is not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: Model, switch: float = SWITCH, with_spans: bool = True, keep: list[Column] | None = None) -> DataFrame:
    """doc_id (and the columns ``keep``), lang_pred, score and, if asked for, spans of words, per row of ``docs``."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), *(keep or []))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", lang_pred string, score double" + ", spans array<struct<first_word: long, words: long, lang: string>>" * with_spans
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), switch, with_spans), schema)
