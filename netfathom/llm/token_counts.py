"""Token counts by rank-synchronous merging of ragged symbol arrays.

The vocabulary is that of a sentencepiece BPE model with identity normalisation, escaped spaces, a dummy prefix and byte
fallback. Texts are cut where no piece of the vocabulary spans two neighbouring characters, so each part ("unit") merges by
itself; each distinct unit of a block is merged once. All units are held as one ragged array, and in every round each
unit's best pair (highest score, then leftmost) is merged at the same time, until no unit has a pair left. The symbols
that survive are counted, a character outside the vocabulary as its bytes. Counts of units are kept between blocks, up to
``CACHE`` of them.

A unit of more than ``LONG`` symbols (a run without breaks) would take as many rounds as it has merges. In such a one all
occurrences of the best pair are merged in a round, as long as that pays and makes no better pair; the rest is done with a
heap of its pairs, so the time is near to linear in its length.

Null and empty texts have 0 bytes and 0 tokens. Whole texts are counted, however long; repeated rows count alike; other
columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textblocks import U64, blocks, mix, powers

CACHE = 3_000_000
LONG = 256
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


class Merges:
    """Symbols and merge ranks of a model. Symbol 0 stands for any character that is in no piece."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        chars = sorted({c for p in scores for c in p})
        symbol = {s: i + 1 for i, s in enumerate([*chars, *sorted(p for p in scores if len(p) > 1)])}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.char = np.zeros(0x110000, np.uint16)
        for c in chars:
            self.char[ord(c)] = symbol[c]
        self.space = symbol["▁"]
        self.char[32] = self.space
        self.joins = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        rows = []
        for p in scores:
            for a, b in zip(p, p[1:]):
                self.joins[symbol[a], symbol[b]] = True
            rows += [(symbol[p[:i]] << 32 | symbol[p[i:]], order[scores[p]], symbol[p]) for i in range(1, len(p)) if p[:i] in symbol and p[i:] in symbol]
        rows.sort()
        self.pair = np.array([r[0] for r in rows], U64)
        self.rank = np.array([r[1] for r in rows], U64)
        self.made = np.array([r[2] for r in rows], np.int64)
        self.table: dict[int, tuple[int, int]] | None = None
        #: tokens of a symbol that survives
        self.tokens = np.array([1, *(1 if s in scores else len(s.encode()) for s in symbol)], np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair, ``_NONE`` if it is none, and its place in the table."""
        key = (left.astype(U64) << U64(32)) | right.astype(U64)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], _NONE), at

    def long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one unit that survive, in near to linear time."""
        while len(symbols) > 1:
            rank, at = self._ranks(symbols[:-1], symbols[1:])
            best = rank.min()
            if best == _NONE:
                return symbols
            where = np.flatnonzero(rank == best)
            # in a run of overlapping occurrences every second one is merged, from the left
            run = np.maximum.accumulate(np.where(np.diff(where, prepend=-2) > 1, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            if len(where) * 256 < len(symbols):
                break
            merged, keep = symbols.copy(), np.ones(len(symbols), bool)
            merged[where], keep[where + 1] = self.made[at[where]], False
            merged, fresh = merged[keep], np.cumsum(keep)[where] - 1
            near = np.unique(np.r_[fresh - 1, fresh])
            near = near[(near >= 0) & (near < len(merged) - 1)]
            if (self._ranks(merged[near], merged[near + 1])[0] < best).any():
                break  # a pair that is better than this one came up: its turn is before the other occurrences
            symbols = merged
        return self._by_heap(symbols)

    def _by_heap(self, symbols: np.ndarray) -> np.ndarray:
        if self.table is None:
            self.table = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.made.tolist())))
        table, own, n = self.table, symbols.tolist(), len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank, _ = self._ranks(symbols[:-1], symbols[1:])
        where = np.flatnonzero(rank != _NONE)
        heap = ((rank[where] << U64(32)) | where.astype(U64)).tolist()
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFF
            j = after[i]
            if own[i] < 0 or j >= n:
                continue
            found = table.get(own[i] << 32 | own[j])
            if found is None or found[0] != top >> 32:
                continue  # one of the two has changed since
            own[i], own[j] = found[1], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := table.get(own[i] << 32 | own[k])) is not None:
                    heapq.heappush(heap, new[0] << 32 | i)
            h = before[i]
            if h >= 0 and (new := table.get(own[h] << 32 | own[i])) is not None:
                heapq.heappush(heap, new[0] << 32 | h)
        return np.array([x for x in own if x >= 0], np.int64)

    def count(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Tokens of each unit, given as a ragged array."""
        out, lens = np.zeros(len(bounds) - 1, np.int64), np.diff(bounds)
        for i in np.flatnonzero(lens > LONG).tolist():
            out[i] = self.tokens[self.long(symbols[bounds[i] : bounds[i + 1]])].sum()
        unit = np.repeat(np.arange(len(out)), lens)
        if (lens > LONG).any():
            short = lens[unit] <= LONG
            symbols, unit = symbols[short], unit[short]
        while len(symbols):
            key = (symbols[:-1].astype(U64) << U64(32)) | symbols[1:].astype(U64)
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            open_ = (self.pair[at] == key) & (unit[:-1] == unit[1:])
            place = np.full(len(symbols), _NONE)
            where = np.flatnonzero(open_)
            place[where] = (self.rank[at[where]] << U64(32)) | where.astype(U64)
            first = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
            best = np.minimum.reduceat(place, first)
            live = best != _NONE
            done = np.repeat(~live, np.diff(np.r_[first, len(symbols)]))
            if done.any():
                np.add.at(out, unit[done], self.tokens[symbols[done]])
            left = (best[live] & U64(0xFFFFFFFF)).astype(np.int64)
            symbols[left] = self.made[at[left]]
            keep = ~done
            keep[left + 1] = False
            symbols, unit = symbols[keep], unit[keep]
        return out


_loaded: dict[str, tuple] = {}


def _model(path: str) -> tuple[Merges, list]:
    if path not in _loaded:
        _loaded[path] = (Merges(path), [np.zeros(0, U64), np.zeros(0, np.int32)])
    return _loaded[path]


def count_tokens(column: pa.Array, path: str) -> Iterator[tuple[range, np.ndarray, np.ndarray]]:
    """Rows, bytes and tokens of the texts of each block."""
    merges, kept = _model(path)
    for block in blocks(column):
        n_bytes = np.diff(block.at)
        points = np.frombuffer(block.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.r_[0, np.cumsum(_LEAD[block.data])][block.at]
        full = np.flatnonzero(n_bytes)
        symbols = np.insert(merges.char[points], at[full], merges.space)
        at = at + np.searchsorted(full, np.arange(block.n + 1))
        strange = np.flatnonzero(symbols == 0)
        split = np.ones(len(symbols), bool)
        split[1:] = ~merges.joins[symbols[:-1], symbols[1:]]
        split[at[:-1][full]] = True
        start = np.flatnonzero(split)
        end = np.r_[start[1:], len(symbols)].astype(np.int64)
        known = symbols[start] > 0
        start, end = start[known], end[known]
        h = np.zeros(len(symbols) + 1, U64)
        np.cumsum(mix(symbols.astype(U64) + U64(7)) * powers(max(1, len(symbols)))[0][: len(symbols)], out=h[1:])
        key = mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(U64))
        units, first, inverse = np.unique(key, return_index=True, return_inverse=True)
        have, counts = kept
        place = np.minimum(np.searchsorted(have, units), max(0, len(have) - 1))
        old = have[place] == units if len(have) else np.zeros(len(units), bool)
        tokens = np.zeros(len(units), np.int64)
        tokens[old] = counts[place[old]]
        if not old.all():
            s, e = start[first[~old]], end[first[~old]]
            lens = e - s
            bounds = np.r_[0, np.cumsum(lens)]
            flat = np.repeat(s - bounds[:-1], lens) + np.arange(bounds[-1])
            tokens[~old] = merges.count(symbols[flat].astype(np.int64), bounds)
            if len(have) + (~old).sum() > CACHE:
                have, counts, where = have[:0], counts[:0], np.zeros((~old).sum(), np.int64)
            else:
                where = np.searchsorted(have, units[~old])
            kept[:] = [np.insert(have, where, units[~old]), np.insert(counts, where, tokens[~old])]
        doc = np.searchsorted(at, start, "right") - 1
        total = np.bincount(doc, weights=tokens[inverse], minlength=block.n).astype(np.int64)
        if len(strange):
            own = np.searchsorted(at, strange, "right") - 1
            point = points[strange - np.searchsorted(full, own, "right")]  # without the prefixes up to there
            total += np.bincount(own, weights=1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF), minlength=block.n).astype(np.int64)
        yield block.rows, n_bytes, total


def _counted(path: str | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = path or default_model()
        for batch in batches:
            parts = [(b, t) for _, b, t in count_tokens(batch.column(1), model)]
            if parts:
                n_bytes, tokens = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
                yield pa.record_batch([batch.column(0), pa.array(n_bytes), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs`` (doc_id, text). ``path``: the model's place on the
    executors; each finds its own copy where none is given."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counted(path, limit), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
