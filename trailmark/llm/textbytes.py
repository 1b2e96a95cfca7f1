"""Vectorised text helpers for tasks: Arrow string columns as byte arrays, words, rolling hashes.

A column of texts is handled in chunks of whole rows (``chunks``), each one byte array with row
offsets, so memory follows the chunk size and not the Arrow batch; a single text larger than the
chunk size is a chunk of its own.

Hashes are 64-bit polynomials over bytes (arithmetic modulo 2**64): a prefix sum per chunk gives
the hash of any byte range in O(1). ``mix`` finishes them so that all bits are usable.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1  # odd, so it has an inverse modulo 2**64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_ALPHANUMERIC = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for i, b in enumerate((BASE, BASE_INVERSE)):
            step = np.full(size, b, U64)
            step[0] = 1
            _powers[i] = np.cumprod(step, dtype=U64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (xor-shift and odd multipliers)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


@dataclass
class Chunk:
    """Rows ``lo``..``hi`` of a batch: their bytes and, per row, offsets into them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.offsets)


def chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow string (or binary) column as UTF-8 bytes; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if not pa.types.is_binary(column.type) else b"")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield Chunk(lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


SLICE_BYTES = 8 << 20


def slices(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to about ``size`` bytes of a text column, so that what a task makes of one
    stays small however many long texts Spark puts into a batch."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths, dtype=np.int64) // size
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if hi > lo:
                yield batch.slice(lo, hi - lo)


def values(column: pa.Array) -> Iterator:
    """Python values of a column one at a time (a list of them would hold all its bytes twice)."""
    return (x.as_py() for x in column)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial; ``range_hash`` turns them into hashes of byte ranges."""
    p, _ = powers(len(data))
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * p[:len(data)], dtype=U64, out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of the bytes ``start``..``end``, independent of where they lie."""
    _, inverse = powers(len(prefix))
    return (prefix[end] - prefix[start]) * inverse[start]


@dataclass
class Words:
    """Words of a chunk: byte ranges, the hash of each, and per row where its words begin."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # one more than rows; words of row i are first[i]..first[i+1]


def words(chunk: Chunk, lower: bool = False, between: np.ndarray = SPACE) -> Words:
    """Runs of bytes other than those ``between`` words: by default space, tab, newline, vertical
    tab, form feed, carriage return."""
    data = LOWER[chunk.data] if lower else chunk.data
    gap = between[data]
    before = np.ones(len(data) + 1, dtype=bool)
    before[1:] = gap
    before[chunk.offsets] = True  # a row's first byte follows a gap
    after = np.ones(len(data) + 1, dtype=bool)
    after[:-1] = gap
    after[chunk.offsets] = True  # and its last byte precedes one
    start = np.flatnonzero(~gap & before[:-1])
    end = np.flatnonzero(~gap & after[1:]) + 1
    h = mix(range_hash(prefix_hash(data), start, end) + (end - start).astype(U64))
    return Words(start, end, h, np.searchsorted(start, chunk.offsets))


_STEP = [U64(pow(0xC2B2AE3D27D4EB4F | 1, j, 1 << 64)) for j in range(64)]


def shingles(word_hash: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive words (``len - k + 1`` of them, none if fewer)."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = word_hash[:n].copy()
    for j in range(1, k):
        out += word_hash[j:j + n] * _STEP[j]
    return mix(out)


def runs(word_hash: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """``shingles`` that begin at the words ``at`` only."""
    out = word_hash[at]
    for j in range(1, k):
        out += word_hash[at + j] * _STEP[j]
    return mix(out)


def shingle_rows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles that stay within a row: hash, index of the first word, and row bounds."""
    n_words = np.diff(w.first)
    h = shingles(w.hash, k)
    at = np.arange(len(h))
    row = np.searchsorted(w.first, at, side="right") - 1
    inside = at + k <= w.first[row + 1] if len(h) else np.zeros(0, bool)
    bounds = np.zeros(len(n_words) + 1, np.int64)
    np.cumsum(np.maximum(n_words - k + 1, 0), out=bounds[1:])
    return h[inside], at[inside], bounds


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
