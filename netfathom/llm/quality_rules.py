"""Line-first cleaning of texts.

Each line is judged by itself: punctuation (an end without a mark, shouting marks, symbols, upper case), navigation (cells
between bars, breadcrumbs) and boilerplate (a repeat of an earlier line; a short line that many different texts have, as
banners, licences and notices, of whatever language). Lines that fail are removed, and a document that loses more than
``MOST_LOST`` percent of its characters is rejected. Counts over the whole text (``base_failed``) reject before that.

What many texts have is counted over all documents: short lines (``SHORT`` words at most) per distinct text, in a shuffle of
pairs of hashes. Those in a share of ``COMMON`` of the texts that have short lines, and in ``COMMON_LEAST``, are common; there
are no more of them than short lines per text divided by the share, however many documents there are, so they are broadcast.

A null text is empty: no words, not kept, and its cleaned text is empty. Lines without a word are neither judged nor
counted. Repeated rows are judged alike, and exact copies of a text count once; texts of any length are taken whole; other
columns are ignored. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import NONSPACE, U64, Block, blocks, mix, windows

MOST_LOST = 50
SHORT = 15
COMMON, COMMON_LEAST = 0.001, 20


def _class(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_SYMBOL, _BAR, _SHOUT = _class("#*$%&|<>"), _class("|<>"), _class("!")
_UPPER, _LOWER = _class(bytes(range(65, 91))), _class(bytes(range(97, 123)))
_ENDS = _class(".!?:;\"')]")
_ENDS[0x80:] = True  # other scripts' marks and quotes
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _sums(flag: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flag) + 1, np.int32)
    np.cumsum(flag, out=out[1:])
    return out


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values occur twice or more, and which are not the first of theirs."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    often, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order] = same[:-1]
    often[order] = same[:-1] | same[1:]
    return often, later


def _per(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(_sums(values)[bounds]).astype(np.int64)


def lines_of(block: Block, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each line with a word: start, end, first word, word behind the last, document. Lines lie between documents' starts
    and ends and line breaks."""
    at, breaks = block.at, np.flatnonzero(block.data == 10)
    of = np.searchsorted(at, breaks, "right") - 1
    doc = np.repeat(np.arange(block.n), np.bincount(of, minlength=block.n) + 1)
    owner = np.concatenate([np.arange(block.n), of])
    lo, hi = np.concatenate([at[:-1], breaks + 1]), np.concatenate([at[1:], breaks])
    lo, hi = lo[np.lexsort((lo, owner))], hi[np.lexsort((hi, owner))]
    w0, w1 = np.searchsorted(starts, lo), np.searchsorted(starts, hi)
    full = w1 > w0
    return lo[full], hi[full], w0[full], w1[full], doc[full]


def _short_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of each text's distinct short lines, from the first word to the last, and of the text."""
    for batch in batches:
        for block in blocks(batch.column(0)):
            starts, ends, _ = block.words(NONSPACE)
            _, _, w0, w1, doc = lines_of(block, starts)
            short = w1 - w0 <= SHORT
            w0, w1, doc, h = w0[short], w1[short], doc[short], block.hashed(False)
            line, text = block.spans(h, starts[w0], ends[w1 - 1]), block.spans(h, block.at[:-1], block.at[1:])[doc]
            both = np.unique(np.stack([line, text], 1), axis=0) if len(line) else np.zeros((0, 2), U64)
            yield pa.record_batch([pa.array(np.ascontiguousarray(both[:, i]).view(np.int64)) for i in range(2)], names=["line", "text"])


def common_lines(docs: DataFrame, share: float = COMMON, least: int = COMMON_LEAST) -> np.ndarray:
    """Sorted hashes of the short lines that many distinct texts have."""
    pairs = cut(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_short_lines, "line long, text long").distinct())
    texts = pairs.select("text").distinct().count()
    often = pairs.groupBy("line").agg(F.count("*").alias("n")).where(F.col("n") >= max(least, share * texts))
    return np.sort(np.array([r[0] for r in often.select("line").collect()], np.int64).view(U64))  # at most lines per text / share


def judge(column: pa.Array, common: np.ndarray) -> Iterator[tuple]:
    """For each block: the block, per document (words, word_chars, symbols, dup_lines, repeat_words, kept characters
    and all characters in lines), and per line (start, end, whether it stays, document)."""
    for block in blocks(column):
        data, at = block.data, block.at
        starts, ends, bounds = block.words(NONSPACE)
        h = block.hashed(False)
        words = block.spans(h, starts, ends)
        grams, gat = windows(words, bounds, 3)
        doc = np.repeat(np.arange(block.n), np.diff(gat))
        often, _ = _repeats(grams ^ mix(doc.astype(U64) + U64(1)))
        often &= np.diff(bounds)[doc] >= 3
        cover = np.zeros(len(words) + 3, np.int32)
        first = (np.arange(len(grams)) - gat[doc] + bounds[doc])[often]
        for j in range(3):
            cover[first + j] = 1
        chars = _sums(_LEAD[data])
        in_words = np.diff(np.r_[0, np.cumsum(chars[ends] - chars[starts], dtype=np.int64)][bounds])

        lo, hi, w0, w1, line_doc = lines_of(block, starts)
        _, later = _repeats(block.spans(h, lo, hi) ^ mix(line_doc.astype(U64) + U64(1)))

        n_words = w1 - w0
        size = (chars[hi] - chars[lo]).astype(np.int64)
        symbols = _sums(_SYMBOL[data])
        of_class = lambda c: (lambda s: (s[hi] - s[lo]).astype(np.int64))(_sums(c[data]))
        upper, lower, bars, shouts = of_class(_UPPER), of_class(_LOWER), of_class(_BAR), of_class(_SHOUT)
        line = block.spans(h, starts[w0], ends[w1 - 1]) if len(w1) else lo.astype(U64)
        banner = common[np.minimum(np.searchsorted(common, line), len(common) - 1)] == line if len(common) else np.zeros(len(line), bool)
        end = data[ends[w1 - 1] - 1] if len(w1) else data[:0]
        punctuation = ~_ENDS[end] & (n_words >= 3) | (shouts * 4 > n_words) & (shouts >= 2) | ((symbols[hi] - symbols[lo]) * 4 > n_words) | (upper > 2 * lower) & (upper >= 10)
        navigation = (bars >= 2) & (bars * 6 >= n_words)
        boilerplate = banner & (n_words <= SHORT) | later & (n_words >= 3)
        stays = ~(punctuation | navigation | boilerplate)
        sums = lambda v: np.bincount(line_doc, weights=v, minlength=block.n).astype(np.int64)
        per = (np.diff(bounds), in_words, np.diff(symbols[at]).astype(np.int64), sums(later), np.diff(np.r_[0, np.cumsum(cover[: len(words)], dtype=np.int64)][bounds]), sums(size * stays), sums(size))
        yield block, per, (lo, hi, stays, line_doc)


def _rules(common, with_text: bool, most_lost: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[tuple] = []
            texts: list[str] = []
            for block, per, (lo, hi, stays, line_doc) in judge(batch.column(1), common.value):
                parts.append(per)
                if with_text:
                    raw, lines = block.data.tobytes(), [[] for _ in range(block.n)]
                    for a, b, d in zip(lo[stays].tolist(), hi[stays].tolist(), line_doc[stays].tolist()):
                        lines[d].append(raw[a:b])
                    texts += [b"\n".join(x).decode() for x in lines]
            if not parts:
                continue
            n, chars, symbols, dup, repeat, stay, all_ = (np.concatenate(x) for x in zip(*parts))
            failed = (n < 50) | (100 * repeat > 50 * n)
            kept = ~failed & (100 * stay >= (100 - most_lost) * all_)
            columns = [batch.column(0), *map(pa.array, (n.astype(np.int64), chars.astype(np.int64), symbols, dup, repeat.astype(np.int64), failed, kept, np.where(all_ > 0, stay / np.maximum(1, all_), 0.0)))]
            yield pa.record_batch(columns + [pa.array(texts, pa.string())] * with_text, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "share_left", "cleaned"][: 9 + with_text])

    return run


def line_rules(docs: DataFrame, with_text: bool = True, most_lost: int = MOST_LOST, common: np.ndarray | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): counts, base_failed, kept, share_left (characters in lines that stay) and, if
    asked for, the cleaned text. ``common``: hashes of common lines; those of ``docs`` where none are given."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, share_left double" + ", cleaned string" * with_text
    told = docs.sparkSession.sparkContext.broadcast(common_lines(docs) if common is None else common)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_rules(told, with_text, most_lost), schema)
