"""Simple-8b word-aligned integer coding (Anh and Moffat, 2010), in numpy.

A 64-bit word holds a 4-bit selector and 60 bits with a fixed number of
equally wide values. Selector 0 is an escape: its payload is an index into a
side list of values of 60 bits and more. Values are coded in blocks of
``BLOCK`` whose first word is recorded, so any block decodes alone and all
blocks of a segment decode together.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1024
#: Values per word by selector; width is 60 // count. Selector 0 escapes.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = 60 // COUNTS
_ROW = BLOCK + 60  # a block with room for a last word that isn't full


def _bits(values: np.ndarray) -> np.ndarray:
    high = (values >> np.uint64(32)).astype(np.float64)
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, np.frexp(high)[1] + 32, np.frexp(low)[1]).astype(np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, first word of each block, escaped values) for unsigned values."""
    n = len(values)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint64)
    rows = np.zeros((blocks, _ROW), np.uint64)
    whole = n // BLOCK
    rows[:whole, :BLOCK] = values[: whole * BLOCK].reshape(whole, BLOCK)
    if whole < blocks:
        rows[whole, : n - whole * BLOCK] = values[whole * BLOCK :]
    flat = rows.reshape(-1)
    if values.dtype.itemsize <= 4:
        bits = np.frexp(flat.astype(np.float64))[1].astype(np.uint8)
    else:
        bits = _bits(flat)
    selector = np.full(len(flat), 14, np.uint8)
    selector[bits > 60] = 0
    # widest value in the window of each count, from windows of powers of two
    doubled, size = bits, 1
    for s in range(13, 0, -1):
        count = int(COUNTS[s])
        while 2 * size <= count:
            wider = doubled.copy()
            np.maximum(doubled[:-size], doubled[size:], out=wider[:-size])
            doubled, size = wider, 2 * size
        gap = count - size
        window = np.maximum(doubled[: len(flat) - gap], doubled[gap:]) if gap else doubled
        np.putmask(selector[: len(window)], window <= WIDTHS[s], np.uint8(s))
    at = np.arange(blocks, dtype=np.int64) * _ROW
    end = at + BLOCK
    end[-1] = at[-1] + n - (blocks - 1) * BLOCK
    is_start = np.zeros(len(flat), bool)
    live = np.arange(blocks)
    while live.size:  # all blocks step one word at a time, together
        here = at[live]
        is_start[here] = True
        at[live] = here + COUNTS[selector[here]]
        live = live[at[live] < end[live]]
    starts = np.flatnonzero(is_start)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(60)
    for s in range(1, 15):
        mine = np.flatnonzero(chosen == s)
        for k in range(int(COUNTS[s]) if mine.size else 0):
            words[mine] |= flat[starts[mine] + k] << np.uint64(k * WIDTHS[s])
    escaped = np.flatnonzero(chosen == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    first = np.searchsorted(starts, np.arange(blocks) * _ROW)
    return words, first, flat[starts[escaped]]


def decode(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` values (uint64) of :func:`encode`, all blocks at once."""
    if not n:
        return np.empty(0, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    before = np.cumsum(COUNTS[chosen]) - COUNTS[chosen]
    per_block = np.diff(np.append(first, len(words)))
    place = before + np.repeat(np.arange(len(first)) * _ROW - before[first], per_block)
    rows = np.zeros(len(first) * _ROW, np.uint64)
    for s in range(1, 15):
        mine = np.flatnonzero(chosen == s)
        if mine.size:
            mask = np.uint64((1 << int(WIDTHS[s])) - 1)
            picked, at = words[mine], place[mine]
            for k in range(int(COUNTS[s])):
                rows[at + k] = (picked >> np.uint64(k * WIDTHS[s])) & mask
    out = np.flatnonzero(chosen == 0)
    rows[place[out]] = escapes[words[out].astype(np.int64)]
    return rows.reshape(len(first), _ROW)[:, :BLOCK].reshape(-1)[:n]


def decode_block(words: np.ndarray, first: np.ndarray, escapes: np.ndarray, n: int, block: int) -> np.ndarray:
    """The values of one block alone."""
    last = first[block + 1] if block + 1 < len(first) else len(words)
    return decode(words[first[block] : last], np.zeros(1, np.int64), escapes, min(BLOCK, n - block * BLOCK))
