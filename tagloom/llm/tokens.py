"""Vectorised tokenizing and rolling hashes over Arrow string batches.

Everything works on the UTF-8 buffer of an Arrow string column, a few
megabytes at a time, so memory follows the chunk and not the batch.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_RNG = np.random.Generator(np.random.PCG64(20240607))
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))
BYTE_CODES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def release() -> None:
    """Give back what earlier tasks of this worker have freed; a worker outlives its tasks and would keep their peak."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim is not None:
        trim(0)


def _power_table(n: int, base: np.uint64) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16) * 5 // 4
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def space_table() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+`` kept as they are; 0 separates."""
    t = np.arange(256, dtype=np.uint16)
    keep = np.ones(256, dtype=bool)
    keep[[0x20, *range(0x09, 0x0E)]] = False
    return np.where(keep, t + 1, 0).astype(np.uint16)


def lower_space_table() -> np.ndarray:
    """As :func:`space_table`, after lower-casing A-Z."""
    t = space_table()
    t[0x41:0x5B] = t[0x61:0x7B]
    return t


def alnum_table() -> np.ndarray:
    """Digits, letters (A-Z lower-cased) and all non-ASCII bytes; the rest separates."""
    t = np.arange(256, dtype=np.uint16) + 1
    t[:0x30] = 0
    t[0x3A:0x61] = 0
    t[0x7B:0x80] = 0
    t[0x41:0x5B] = np.arange(0x61, 0x7B) + 1
    return t


def string_buffer(col) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows, from 0) of a string column; nulls count as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    n = len(col)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def chunks(data: np.ndarray, offs: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of at most ``limit`` bytes (one longer row stands alone) with their bytes and offsets."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


class Words:
    """Words of consecutive rows: byte spans, row pointers and 64-bit hashes."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        codes = table[data]
        inside = codes > 0
        n = len(data)
        before = np.zeros(n, bool)
        after = np.zeros(n, bool)
        if n:
            before[1:] = inside[:-1]
            after[:-1] = inside[1:]
            edge = offs[(offs > 0) & (offs < n)]
            before[edge] = False
            after[edge - 1] = False
        self.codes = codes
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        #: words of row r are ptr[r]:ptr[r + 1]
        self.ptr = np.searchsorted(self.start, offs)
        self.n = len(self.start)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = len(self.codes)
        if not self.n:
            return np.zeros(0, np.uint64)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_CODES[self.codes] * _power_table(n + 1, _P)[:n], out=total[1:])
        return mix((total[self.end] - total[self.start]) * _power_table(n + 1, _P_INV)[self.start])

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ptr) - 1), np.diff(self.ptr))


_CODES = np.concatenate([[np.uint64(0)], BYTE_CODES]).astype(np.uint64)


def rolling(codes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive 64-bit codes (Rabin-Karp modulo 2**64, then mixed)."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(codes * _power_table(n + 1, _P)[:n], out=total[1:])
    return mix((total[k:] - total[:-k]) * _power_table(n + 1, _P_INV)[: n - k + 1])


def window_starts(ptr: np.ndarray, k: int, n: int) -> np.ndarray:
    """Indexes at which ``k`` items lie within one row, for rows given by ``ptr``."""
    ok = np.zeros(n + 1, np.int32)
    has = np.diff(ptr) >= k
    np.add.at(ok, ptr[:-1][has], 1)
    np.add.at(ok, (ptr[1:] - k + 1)[has], -1)
    return np.flatnonzero(np.cumsum(ok[:n]) > 0) if n else np.zeros(0, np.int64)


def union_length(starts: np.ndarray, k: int) -> np.ndarray:
    """Maximal half-open runs covered by windows of ``k`` at ascending ``starts``, as rows (from, to)."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    cut = np.flatnonzero(np.diff(starts) > k)
    return np.stack([starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + k], axis=1)
