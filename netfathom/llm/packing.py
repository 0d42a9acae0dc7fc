"""Packing of tokenised documents into sequences of bounded length.

Each text becomes token ids and an end id. A document is cut at every ``capacity`` tokens; a full piece is a sequence of
its own, and the rests are packed first-fit decreasing. Pieces are dealt at random (by a hash of document and start) to
groups of about ``GROUP_PIECES``, and each group is packed by itself with a tournament tree over its bins: a node holds the
largest room below it, so the first bin with enough room is found on one way down.

Texts are split into the tokenizer's words in numpy; each distinct word of a block is encoded once, by the tokenizer
itself, and kept for later blocks (``CACHE_IDS`` ids at most). Texts with one of its special strings are encoded whole.

Null and empty texts consist of the end id. Rows with equal or null doc_id are packed as rows of their own; other columns
are ignored.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut
from .textblocks import U64, Block, blocks, mix, powers

GROUP_PIECES = 4096
#: Bytes of text that are encoded together.
ENCODE_BYTES = 1 << 20
CACHE_IDS = 12_000_000
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_SUFFIXES = ("re", "ve", "ll", "s", "t", "m", "d")
_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Of each code point: letter, number, white space or other."""
    if not _kinds:
        first = {"L": _LETTER, "N": _NUMBER}
        out = np.fromiter((first.get(unicodedata.category(chr(i))[0], _OTHER) for i in range(0x110000)), np.uint8, 0x110000)
        out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _kinds.append(out)
    return _kinds[0]


def word_starts(points: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the words of the byte-level pre-tokenizer begin: runs of letters, of numbers and of other marks, each with
    one plain space before it; English contractions; and white space, of which the last character stands alone before a
    word. ``at``: the documents' bounds."""
    kind = kinds()[points]
    n = len(points)
    edge = np.ones(n + 1, bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[at] = True
    begin = edge[:-1].copy()
    if not n:
        return begin
    start = np.flatnonzero(begin)
    end = np.r_[start[1:], n]
    # white space before a word of the same document: its last character is cut off, and a plain one goes to the word
    inner = np.zeros(n + 1, bool)
    inner[:n] = True
    inner[at] = False
    space = (kind[start] == _SPACE) & inner[end]
    begin[end[space] - 1] = True
    given = end[space][points[end[space] - 1] == 32]
    begin[given] = False
    # contractions: an apostrophe alone in its run, without a space, and one of the suffixes
    lone = start[(kind[start] == _OTHER) & (end - start == 1) & (points[start] == 39) & begin[start]]
    pad = np.r_[points, np.zeros(4, points.dtype)]
    free = np.r_[inner, np.zeros(4, bool)]
    done = np.zeros(len(lone), bool)
    for s in _SUFFIXES:
        hit = ~done
        for j, c in enumerate(s):
            hit &= (pad[lone + 1 + j] == ord(c)) & free[lone + 1 + j]
        done |= hit
        here = lone[hit]
        begin[here + 1] = False
        after = here + 1 + len(s)
        begin[after[after < n]] = True
    return begin


class Encoder:
    """The ids of texts by a tokenizer of the ``tokenizers`` library, word by word."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units; threads would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special)).encode()) if special else None
        self.clear()

    def clear(self) -> None:
        self.have, self.place = np.zeros(0, U64), np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        found: list[list[int]] = []
        for lo in range(0, len(words), 2000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(words[lo : lo + 2000], add_special_tokens=False)]
        size = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.uint32, int(size.sum()))
        if self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(flat), self.used), np.uint32)])
        self.pool[self.used : self.used + len(flat)] = flat
        where = np.searchsorted(self.have, keys)
        self.have = np.insert(self.have, where, keys)
        self.place = np.insert(self.place, where, np.arange(len(keys)) + len(self.first))
        self.first = np.r_[self.first, self.used + np.cumsum(size) - size]
        self.size = np.r_[self.size, size]
        self.used += len(flat)

    def encode(self, block: Block, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all documents of a block, each followed by ``last``, and the documents' bounds."""
        raw = block.data.tobytes()
        text = raw.decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.r_[0, np.cumsum(_LEAD[block.data])][block.at]
        begin = word_starts(points, at)
        start = np.flatnonzero(begin)
        end = np.r_[start[1:], len(points)].astype(np.int64)
        h = np.zeros(len(points) + 1, U64)
        np.cumsum(mix(points.astype(U64) + U64(7)) * powers(max(1, len(points)))[0][: len(points)], out=h[1:])
        key = mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(U64))
        units, one, inverse = np.unique(key, return_index=True, return_inverse=True)
        if self.used > CACHE_IDS:
            self.clear()
        hit = np.searchsorted(self.have, units)
        new = np.ones(len(units), bool)
        inside = hit < len(self.have)
        new[inside] = self.have[hit[inside]] != units[inside]
        if new.any():
            self._learn(units[new], [text[a:b] for a, b in zip(start[one[new]].tolist(), end[one[new]].tolist())])
        unit = self.place[np.searchsorted(self.have, units)][inverse] if len(units) else np.zeros(0, np.int64)
        size, doc = self.size[unit], np.searchsorted(at, start, "right") - 1
        own = np.bincount(doc, weights=size, minlength=block.n).astype(np.int64)
        whole: dict[int, np.ndarray] = {}
        if self.special:
            for m in self.special.finditer(raw):
                d = int(np.searchsorted(block.at, m.start(), "right")) - 1
                if d not in whole and m.end() <= block.at[d + 1]:
                    whole[d] = np.array(self.tokenizer.encode(raw[block.at[d] : block.at[d + 1]].decode(), add_special_tokens=False).ids, np.uint32)
        if whole:
            plain = ~np.isin(doc, list(whole))
            unit, size, doc = unit[plain], size[plain], doc[plain]
            own[list(whole)] = [len(x) for x in whole.values()]
        bounds = np.r_[0, np.cumsum(own + 1)]
        ids = np.full(bounds[-1], last, np.uint32)
        before = np.cumsum(size) - size
        lead = np.r_[0, np.cumsum(np.bincount(doc, weights=size, minlength=block.n).astype(np.int64))]
        to = np.repeat(before - lead[doc] + bounds[doc] - before, size) + np.arange(size.sum())
        ids[to] = self.pool[np.repeat(self.first[unit] - before, size) + np.arange(size.sum())]
        for d, x in whole.items():
            ids[bounds[d] : bounds[d] + len(x)] = x
        return ids, bounds


_loaded: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _pieces(path: str | None, capacity: int, last: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = path or default_tokenizer()
        encoder = _loaded.get(place) or _loaded.setdefault(place, Encoder(place))
        for batch in batches:
            rows: list[tuple] = []
            for block in blocks(batch.column(1), ENCODE_BYTES):
                ids, bounds = encoder.encode(block, last)
                raw = memoryview(ids.astype("<u4").tobytes())
                for d, row in enumerate(block.rows):
                    a, b = int(bounds[d]), int(bounds[d + 1])
                    rows += [(row, s - a, min(capacity, b - s), zlib.crc32(raw[4 * s : 4 * min(b, s + capacity)]), b - a) for s in range(a, b, capacity)]
            if rows:
                row, *others = zip(*rows)
                yield pa.record_batch([batch.column(0).take(pa.array(row)), *(pa.array(x, pa.int64()) for x in others)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item and its offset there. Ties in length go by position."""
    order = np.argsort(-lengths, kind="stable").tolist()
    size = 1 << max(1, (max(1, len(lengths)) - 1).bit_length())
    room = [capacity] * (2 * size)
    bins, offsets, length = [0] * len(lengths), [0] * len(lengths), lengths.tolist()
    for i in order:
        need, k = length[i], 1
        while k < size:
            k *= 2
            if room[k] < need:
                k += 1
        bins[i], offsets[i] = k - size, capacity - room[k]
        room[k] -= need
        while k > 1:
            k >>= 1
            more = max(room[2 * k], room[2 * k + 1])
            if room[k] == more:
                break
            room[k] = more
    return np.array(bins, np.int64), np.array(offsets, np.int64)


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        bins, offsets = first_fit_decreasing(table["length"].to_numpy(), capacity)
        group = table["group"].to_numpy()
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array((group << 32) | bins)).append_column("offset", pa.array(offsets))

    return run


def pack(docs: DataFrame, capacity: int = 2048, end_id: int = 1, path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Per piece of the rows of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    ``path``: the tokenizer's place on the executors; each finds its own copy where none is given."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    pieces = cut(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_pieces(path, capacity, end_id), schema))
    groups = -(-pieces.count() // group_pieces) or 1
    # by their place in the checkpoint, so that repeated rows are spread too
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("long"))
    return dealt.groupBy("group").applyInArrow(_pack(capacity), schema + ", sequence_id long, offset long")
