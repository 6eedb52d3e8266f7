"""Word shingles of whole texts as 64-bit hashes, in numpy over the bytes of a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .common import slices_by_bytes

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
SLICE_BYTES = 1 << 20


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values (the splitmix64 finaliser)."""
    x = np.asarray(x, np.uint64) + np.uint64((seed * int(_ODD)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mixed(np.arange(256), 7)


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64, by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64
_CACHE = {"up": _powers(_BASE, 1 << 12), "down": _powers(pow(_BASE, -1, 1 << 64), 1 << 12)}


def _power(which: str, n: int) -> np.ndarray:
    if len(_CACHE[which]) < n:
        _CACHE[which] = _powers(_BASE if which == "up" else pow(_BASE, -1, 1 << 64), 1 << (n - 1).bit_length())
    return _CACHE[which]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of the texts, and the number of words before each text.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    A word's hash is a polynomial over its bytes, taken from one running sum,
    and mixed.
    """
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begins[edges] = inside[edges]  # a text's first word begins with it
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    closes[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[_LOWER[data]] * _power("up", len(data))[: len(data)], out=run[1:])
    value = (run[last] - run[first]) * _power("down", len(data))[first]
    return mixed(value, 1), np.searchsorted(first, offsets)


def window_hashes(words: np.ndarray, before: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of ``width`` words, and the windows before each text.

    A text with fewer words, but at least one, has one window of all its words.
    """
    n = np.diff(before)
    windows = np.where(n >= width, n - width + 1, np.minimum(n, 1))
    ends = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(n)), windows)
    at = np.arange(ends[-1]) - ends[owner] + before[owner]
    stop = before[owner + 1]
    value = np.zeros(len(at), np.uint64)
    padded = np.concatenate([words, np.zeros(width, np.uint64)])
    for k in range(width):
        here = padded[at + k]
        if k:
            here = np.where(at + k < stop, here, np.uint64(0))
        value = mixed(value ^ here, 2)
    return value, ends


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, its distinct shingle hashes in ascending order)."""
    for a, b in slices_by_bytes(offsets, SLICE_BYTES):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        values, ends = window_hashes(*word_hashes(part, local), width)
        for i in range(b - a):
            own = np.sort(values[ends[i] : ends[i + 1]])
            if len(own) > 1:
                keep = np.empty(len(own), bool)
                keep[0] = True
                np.not_equal(own[1:], own[:-1], out=keep[1:])
                own = own[keep]
            yield a + i, own
