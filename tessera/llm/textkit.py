"""Vectorised text helpers for Arrow batches (numpy, inside tasks).

Texts are handled as the UTF-8 bytes Arrow already holds.  A batch is worked
in row-aligned pieces of about ``PIECE`` bytes, so memory follows the longest
single text and not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18                                  # about 110 bytes of arrays a byte stand in memory while a piece is worked
MOST_HELD = 1 << 21                              # entries of the power tables that a worker keeps
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15                       # odd: invertible modulo 2**64
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, tuple] = {}
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB),
         np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3))


def ascii_lower(text: str) -> str:
    """A-Z to a-z, every other character unchanged."""
    return text.lower() if text.isascii() else text.translate(_LOWER_MAP)


_LOWER_MAP = {c: c + 32 for c in range(65, 91)}


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def pieces(column: pa.Array, limit: int = PIECE):
    """Yield ``(first_row, offsets, bytes)``; offsets start at 0; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    off = np.frombuffer(bufs[1], np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(off, off[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, off[row:end + 1] - off[row], data[off[row]:off[end]]
        row = end


def _powers(n: int):
    """Powers for at least ``n`` positions; tables above ``MOST_HELD`` go when a shorter text comes."""
    size = next(iter(_POW), 0)
    want = max(PIECE, 1 << int(max(n, 1) - 1).bit_length())
    if size < want or size > max(want, MOST_HELD):
        _POW.clear()
        size = want
        up = np.full(size, _BASE, np.uint64)
        up[0] = 1
        down = np.full(size, _INV, np.uint64)
        down[0] = 1
        _POW[size] = (np.cumprod(up), np.cumprod(down))
    return _POW[size]


def word_spans(data: np.ndarray, off: np.ndarray):
    """Byte starts and ends of the white-space separated words, and each word's row."""
    inside = ~SPACE[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    edge = off[:-1][off[:-1] < len(data)]
    before[edge] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[off] = False
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    rows = np.searchsorted(off, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, off: np.ndarray):
    """A 64-bit hash of every lower-cased word (A-Z only) and the row it stands in."""
    starts, ends, rows = word_spans(data, off)
    if not len(starts):
        return np.zeros(0, np.uint64), rows
    up, down = _powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts]), rows


def shingle_sets(column: pa.Array, width: int = 5):
    """Yield, row by row, the sorted distinct hashes of the ``width``-word shingles.

    A text of fewer words gives its whole word sequence as the one shingle; a
    text without words gives an empty array.
    """
    for _, off, data in pieces(column):
        words, rows = word_hashes(data, off)
        bounds = np.searchsorted(rows, np.arange(len(off)))
        full = np.zeros(0, np.uint64)
        if len(words) >= width:
            full = words[:len(words) - width + 1] * _STEP[0]
            for k in range(1, width):
                full = full + words[k:len(words) - width + 1 + k] * _STEP[k]
            full = mix64(full)
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            n = hi - lo
            if n >= width:
                yield np.unique(full[lo:hi - width + 1])
            elif n:
                h = np.array([n], np.uint64) * np.uint64(0x2545F4914F6CDD1D)
                for k in range(n):
                    h = h + words[lo + k:lo + k + 1] * _STEP[k]
                yield mix64(h)
            else:
                yield words[:0]
