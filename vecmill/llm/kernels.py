"""Vectorised text kernels over Arrow string columns.

All functions work on the UTF-8 bytes of a column, so a batch of documents is
one byte array plus offsets and no Python object per word is made.  Work is cut
into slices of a few megabytes at document boundaries, which bounds memory.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.default_rng(0x5EED)
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * _U64(2) + _U64(1)
_pow = {"up": np.ones(1, _U64), "down": np.ones(1, _U64)}


def _powers(kind: str, n: int) -> np.ndarray:
    if len(_pow[kind]) < n:
        size = 1 << int(n - 1).bit_length()
        base = np.full(size, _BASE if kind == "up" else _INV, _U64)
        base[0] = 1
        _pow[kind] = np.cumprod(base, dtype=_U64)
    return _pow[kind][:n]


def give_back() -> None:
    """Return freed memory to the machine: workers serve later stages too, and what they
    hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim is not None:
        trim(0)


def thrifty(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, for ``mapInArrow``, with what a batch needed given back before the next one,
    and what the task needed (tables of powers too) at its end."""

    def fed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            del batch
            give_back()

    def thrift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(fed(batches))
        _pow.update(up=np.ones(1, _U64), down=np.ones(1, _U64))
        give_back()

    return thrift


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche (xor-shift and multiply)."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x *= _U64(0x94D049BB133111EB)
    x ^= x >> _U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer document is a slice of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def run_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte run ``buf[start:end]``."""
    n = len(buf)
    total = np.zeros(n + 1, _U64)
    np.cumsum(BYTE_CODES[buf] * _powers("up", max(n, 1))[:n], out=total[1:])
    h = (total[ends] - total[starts]) * _powers("down", n + 1)[starts]
    return mix64(h + (ends - starts).astype(_U64) * _U64(0xD6E8FEB86659FD93))


def _table(ranges: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in ranges]] = True
    return t


#: Letters, digits and every byte of a non-ASCII character.
WORD_BYTE = _table("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
WORD_BYTE[128:] = True
#: ASCII white space.
SPACE_BYTE = _table("\t\n\v\f\r ")


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that do not cross documents, and
    the run offsets (n + 1) of the documents."""
    n = len(mask)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    start = mask & (~before | cut[:n])
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    end = mask & (~after | cut[1:])
    starts = np.flatnonzero(start)
    ends = np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of letters and digits) and the word offsets of the documents.

    The caller folds case first, see ``lowered``."""
    starts, ends, at = runs(WORD_BYTE[buf], offsets)
    return run_hashes(buf, starts, ends), at


def lowered(column: pa.Array) -> pa.Array:
    import pyarrow.compute as pc

    return pc.utf8_lower(column)


def shingles(word: np.ndarray, at: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words in a document and the offsets.

    A document of 1 to ``width - 1`` words has one shingle, all its words."""
    n, docs = len(word), len(at) - 1
    count = np.diff(at)
    if not n:
        return np.zeros(0, _U64), np.zeros(docs + 1, np.int64)
    factors = mix64(np.arange(1, width + 1, dtype=_U64))  | _U64(1)
    acc = np.zeros(n, _U64)
    last = np.repeat(at[1:], count)  # end of the word's document
    place = np.arange(n)
    for j in range(width):
        take = place + j
        ok = take < last
        acc += np.where(ok, word[np.minimum(take, n - 1)] * factors[j], _U64(0))
    keep = place + width <= last
    short = (count > 0) & (count < width)
    keep[at[:-1][short]] = True
    out = mix64(acc[keep])
    sizes = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    return out, np.concatenate(([0], np.cumsum(sizes)))


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of each document's values; empty documents give 0."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[at[1:]] - total[at[:-1]]


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``start .. start + length`` of all runs, one after the other."""
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(n) + np.repeat(starts - (ends - lengths), lengths)


class HashStore:
    """Sorted hashes with a row number each: a cache of what earlier batches computed.

    ``bound`` is the most entries kept; when it is passed the cache starts afresh,
    so memory does not grow with the input and results do not change."""

    def __init__(self, bound: int = 3_000_000):
        self.bound, self.keys, self.rows, self.size = bound, np.zeros(0, _U64), np.zeros(0, np.int64), 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 where it is new."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rows[at], -1)

    def full(self, more: int) -> bool:
        return bool(self.size) and self.size + more > self.bound

    def clear(self) -> None:
        self.keys, self.rows, self.size = np.zeros(0, _U64), np.zeros(0, np.int64), 0

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Give new (sorted, distinct) keys the next rows."""
        rows = np.arange(self.size, self.size + len(keys))
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)
        self.size += len(keys)
        return rows
