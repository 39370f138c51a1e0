"""Hashes of byte windows, and the split of a document's windows into runs that share an anchor.

A window of ``DEPTH`` bytes holds ``SPAN`` blocks of ``BLOCK`` bytes; its anchor is the block of least hash, the first on
ties. Which block that is depends on the window's bytes alone, so equal windows have equal anchors at equal offsets, and
windows can be compared within anchors. Consecutive windows with the same anchor make a run.
"""

from __future__ import annotations

import numpy as np

from assaykit.llm._shingles import U64, mix

BLOCK = 64
PIECE = 1 << 20
#: Two families of byte values and odd multipliers, for two independent hashes.
_TABLES = [mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15 + 2 * family)) for family in range(2)]
_ODDS = [[U64((pow(0x5851F42D4C957F2D, k + 3 + 16 * family, 1 << 64) * 0x9E3779B97F4A7C55) % (1 << 64) | 1) for k in range(12)] for family in range(2)]
_PLACE = U64((1 << 28) - 1)


def block_hashes(raw: np.ndarray, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 8 and of the 64 bytes from each position that has them."""
    h, eight, odd = _TABLES[family][raw], None, _ODDS[family]
    for level in range(6):
        half = 1 << level
        h = h[:-half] * odd[level] + h[half:]
        if half == 4:
            eight = h
    return eight, h


def deep_hash(eight: np.ndarray, block: np.ndarray, at: np.ndarray, depth: int, family: int = 0) -> np.ndarray:
    """Hash of the ``depth`` bytes from each of the positions ``at``; depth is a multiple of 8, at least 64."""
    h, odd = block[at], _ODDS[family]
    done = BLOCK
    while done + BLOCK <= depth:
        h = h * odd[6] + block[at + done]
        done += BLOCK
    while done < depth:
        h = h * odd[7] + eight[at + done]
        done += 8
    return mix(h)


def anchors(block: np.ndarray, depth: int) -> np.ndarray:
    """The position of the anchor of the window at each position."""
    span = depth - BLOCK + 1
    low = (mix(block) & ~_PLACE) | np.arange(len(block), dtype=U64)
    width = 1
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < span:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    return (low & _PLACE).astype(np.int64)


def pieces(off: np.ndarray, depth: int):
    """Byte ranges (from, to, first window, last window + 1 for the piece) that together hold each window once."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + PIECE, "right")) - 1)
        a, b = int(off[i]), int(off[j])
        if b - a <= 2 * PIECE:
            yield a, b, a, b
        else:  # one long document
            for s in range(a, b, PIECE):
                yield s, min(b, s + PIECE + depth - 1), s, min(b, s + PIECE)
        i = j


def runs(raw: np.ndarray, off: np.ndarray, depth: int):
    """For each piece: documents, first and last window and anchor of each run (bytes within the document), the hash of the anchor,
    and two hashes of the run."""
    for a, b, first, last in pieces(off, depth):
        if b - a < depth:
            continue
        eight, block = block_hashes(raw[a:b])
        low = anchors(block, depth)
        doc = np.searchsorted(off, np.arange(first, last), "right") - 1
        starts = np.arange(first, last)
        at = starts[(off[doc + 1] - starts >= depth) & (starts - a < len(low))] - a
        if not len(at):
            continue
        anchor = low[at]
        cut = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(at) != 1)) + 1
        lo, hi = at[np.concatenate(([0], cut))], at[np.concatenate((cut - 1, [len(at) - 1]))]
        pos = low[lo]
        shape, both = ((hi - lo) * 1024 + (pos - lo)).astype(U64), []
        for family in range(2):
            short, long = (eight, block) if family == 0 else block_hashes(raw[a:b], family)
            odd = _ODDS[family]
            ends = deep_hash(short, long, lo, depth, family) * odd[8] + deep_hash(short, long, hi, depth, family) * odd[9]
            both.append(mix(ends + shape * odd[10]))
        d = np.searchsorted(off, lo + a, "right") - 1
        base = off[d] - a
        yield d, lo - base, hi - base, pos - base, mix(block[pos]), *both
