"""Vectorised word and shingle hashes over the bytes of an Arrow string column.

Words are maximal runs of bytes other than white space (\\x20, \\x09 to \\x0D); they never cross documents.
A word's hash is a polynomial over its bytes, taken from prefix sums and so in time linear in the bytes; a shingle's
hash mixes the hashes of its words. Hashes only propose: every operator confirms on the words themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 20
_powers: list[np.ndarray] = []
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Odd multipliers, one for each word of a shingle, from a fixed congruential rule.
_ODD = np.array([(pow(0x5851F42D4C957F2D, k + 1, 1 << 64) * 0xD6E8FEB86659FD93) % (1 << 64) | 1 for k in range(16)], dtype=U64)


def _power_table(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, _PIECE + 4096)
        tables = []
        for base in (_BASE, _INVERSE):
            t = np.full(size, base, dtype=U64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: all bits of the result depend on all bits of ``h``."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(32)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, and each row's start and end in them (``n + 1`` offsets; null rows are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_string() if pa.types.is_string(column.type) else pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the documents' offsets in that list."""
    if not len(raw):
        return np.zeros(0, U64), np.zeros(len(off), np.int64)
    ink = ~_BLANK[raw]
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    inner = off[(off > 0) & (off < len(raw))]
    first[inner] |= ink[inner]
    last[inner - 1] |= ink[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(end, start[i] + _PIECE, "right")))
        a, b = int(start[i]), int(end[j - 1])
        power, inverse = _power_table(b - a + 1)
        sums = np.zeros(b - a + 1, U64)
        np.cumsum((raw[a:b].astype(U64) + U64(1)) * power[: b - a], out=sums[1:])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * inverse[s] + (e - s).astype(U64) * U64(_BASE)
        i = j
    return mix(out), np.searchsorted(start, off)


def shingle_hashes(words: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``width`` words of a document, and the documents' offsets in that list."""
    count = np.maximum(np.diff(off) - width + 1, 0)
    at = np.concatenate(([0], np.cumsum(count)))
    n = len(words) - width + 1
    if n <= 0 or not at[-1]:
        return np.zeros(0, U64), at
    h = words[:n] * _ODD[0]
    for k in range(1, width):
        h += words[k : k + n] * _ODD[k]
    inside = np.zeros(n + 1, np.int32)
    full = count > 0
    np.add.at(inside, off[:-1][full], 1)
    np.add.at(inside, (off[:-1] + count)[full], -1)
    return mix(h[np.cumsum(inside[:n]) > 0]), at


def exact_shingles(text: bytes, width: int) -> set[tuple[bytes, ...]]:
    words = text.split()
    return set(zip(*(words[k:] for k in range(width)), strict=False)) if len(words) >= width else set()
