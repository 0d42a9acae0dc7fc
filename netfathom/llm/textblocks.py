"""Words and 64-bit hashes of whole Arrow string columns, in numpy, for use inside Spark tasks.

A batch is cut into blocks of whole documents of about ``BLOCK_BYTES`` (a longer document is a block of its own), so a
task's memory is bounded by the block or by its longest document. All work is on UTF-8 bytes: the word patterns used
here only tell ASCII characters apart, so every byte of a multi-byte character is of one class.
Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(32))
    x = x * U64(_BASE)
    x = x ^ (x >> U64(29))
    x = x * U64(_ODD)
    return x ^ (x >> U64(32))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(_ODD))
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
FOLD_BYTES = np.arange(256, dtype=np.uint8)
FOLD_BYTES[65:91] += 32

#: word characters `[^\x20\x09-\x0D]`
NONSPACE = np.ones(256, bool)
NONSPACE[[0x20, *range(9, 14)]] = False
#: word characters `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` of lower-cased text
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, kept between calls."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _INVERSE)):
            p = np.full(n, b, U64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


class Block:
    """Whole documents of one batch: ``data`` their bytes, ``at`` their bounds in it, ``rows`` their rows in the batch."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lo: int):
        self.data, self.at, self.rows = data, at, range(lo, lo + len(at) - 1)
        self.n = len(at) - 1

    def hashed(self, fold: bool) -> np.ndarray:
        """Running sums of which differences, moved back by ``spans``, hash any run of bytes."""
        n = len(self.data)
        h = np.zeros(n + 1, U64)
        np.cumsum((_FOLD if fold else _BYTE)[self.data] * powers(max(1, n))[0][:n], out=h[1:])
        return h

    @staticmethod
    def spans(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte runs [start, end)."""
        return mix((h[end] - h[start]) * powers(len(h))[1][start] + (end - start).astype(U64) * U64(_ODD))

    def words(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of ``chars`` inside documents, and bounds of each document's words."""
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = chars[self.data]
        edge = inside[1:] != inside[:-1]
        starts = edge & inside[1:]
        ends = edge & inside[:-1]
        cuts = self.at[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(self.data))]
        cuts = cuts[inside[cuts] & inside[cuts + 1]]  # a run that goes on over the end of a document
        starts[cuts] = ends[cuts] = True
        s, e = np.flatnonzero(starts[:-1]), np.flatnonzero(ends)
        return s, e, np.searchsorted(s, self.at)


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a string column as blocks, each row once and in order."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield Block(data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo], lo)
        lo = hi


def windows(words: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words inside documents and the bounds of each document's; fewer words make one window."""
    n = np.diff(bounds)
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out = np.concatenate([[0], np.cumsum(per)])
    total = int(out[-1])
    if not total:
        return np.zeros(0, U64), out
    first = np.repeat(bounds[:-1] - out[:-1], per) + np.arange(total)
    room = np.repeat(np.minimum(n, k), per)
    h = np.zeros(total, U64)
    w = np.concatenate([words, np.zeros(k, U64)])
    for j in range(k):
        h = np.where(room > j, mix(h + w[first + j] + U64(j + 1)), h)
    return h, out
