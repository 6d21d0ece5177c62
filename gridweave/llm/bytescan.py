"""Vectorised scanning of UTF-8 columns: word bounds and 64-bit hashes without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POW = {}

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


#: A 64-bit value for each byte, so that polynomial hashes don't work on small numbers.
BYTE = mix(np.arange(1, 257, dtype=U64) * BASE)


#: Powers that a worker keeps; more are computed anew for the few texts that need them.
KEPT = 1 << 21


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest so far is kept, up to KEPT."""
    have = _POW.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        size = 1 << (size - 1).bit_length()
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= KEPT:
            _POW[int(base)] = have
    return have[:n]


def portions(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of a string column, of at most so many bytes or one row."""
    _, offsets = buffers(column)
    at, n = 0, len(column)
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = end


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and the n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """C with C[j] - C[i] = sum of BYTE[data[k]] * BASE**k for i <= k < j."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE[data] * powers(BASE, len(data)), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], independent of where they lie."""
    n = len(prefix)
    h = (prefix[end] - prefix[start]) * powers(BASE_INV, n)[start]
    return mix(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each run of bytes other than 0x20 and 0x09-0x0D."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    end = np.flatnonzero(solid & (~after | edge[1:])) + 1
    doc = np.searchsorted(offsets, start, side="right") - 1
    return start, end, doc
