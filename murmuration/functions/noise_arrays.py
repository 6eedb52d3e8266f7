"""The noise sources of :mod:`.rng` over numpy arrays: the same keys give the same numbers."""

from __future__ import annotations

import math
import struct

import numpy as np
import xxhash

from .rng import RANGE, SECOND, SQUARES, Keyed, Scripted

#: Spark's seed of its 64-bit hash.
_FIRST = 42
# Primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _ended(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _hashed(key: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """XXH64 of each key under each seed: 8 bytes of a long, 4 of an int, the UTF-8 of anything else."""
    if key.dtype == np.int64:
        h = (seed + _P5 + np.uint64(8)) ^ (_turned(key.view(np.uint64) * _P2, 31) * _P1)
        return _ended(_turned(h, 27) * _P1 + _P4)
    if key.dtype == np.int32:
        h = (seed + _P5 + np.uint64(4)) ^ (key.view(np.uint32).astype(np.uint64) * _P1)
        return _ended(_turned(h, 23) * _P2 + _P3)
    key, seed = np.broadcast_arrays(key, seed)
    return np.array([xxhash.xxh64_intdigest(str(k).encode(), int(s)) for k, s in zip(key.ravel(), seed.ravel(), strict=True)], np.uint64).reshape(key.shape)


class KeyedArrays:
    """:class:`.rng.Keyed` over arrays. Longs and ints are hashed as such, other keys as strings."""

    def __init__(self, source: Keyed):
        self.first = xxhash.xxh64_intdigest(struct.pack("<i", source.seed), _FIRST)

    def _uniform(self, tag: str, keys) -> np.ndarray:
        h = np.array(xxhash.xxh64_intdigest(tag.encode(), self.first), np.uint64).reshape(1)
        with np.errstate(over="ignore"):
            for k in keys:
                h = _hashed(k, h)
        return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53

    def uniform(self, name: str, t: int, *keys: np.ndarray) -> np.ndarray:
        return self._uniform(f"{name}{t}", keys)

    def normal(self, name: str, t: int, *keys: np.ndarray) -> np.ndarray:
        u, v = (self._uniform(f"{name}{t}{end}", keys) for end in "ab")
        return np.sqrt(-2.0 * np.log(u)) * np.cos(2 * math.pi * v)


class ScriptedArrays:
    """:class:`.rng.Scripted` over arrays."""

    def __init__(self, source: Scripted):
        self.source = source

    def hashed(self, name: str, t: int, *keys: np.ndarray) -> np.ndarray:
        h = np.full(1, (self.source.seed + self.source.constant(name)) % RANGE, np.int64)
        for k in (np.full(1, t, np.int64), *keys):
            h = np.fmod(h * 48271 + k.astype(np.int64), RANGE)
        for add in SQUARES:
            h = np.fmod(h * h + add, RANGE)
        return h

    def uniform(self, name: str, t: int, *keys: np.ndarray) -> np.ndarray:
        return (self.hashed(name, t, *keys) + 0.5) / float(RANGE)

    def normal(self, name: str, t: int, *keys: np.ndarray) -> np.ndarray:
        a = self.hashed(name, t, *keys)
        b = np.fmod(a * a + SECOND, RANGE)
        low = (1 << 15) - 1
        return (((a >> 16) + (a & low) + (b >> 16) + (b & low) + 2) / 32768.0 - 2.0) * math.sqrt(3.0)


def arrays_of(source: Keyed | Scripted) -> KeyedArrays | ScriptedArrays:
    return KeyedArrays(source) if isinstance(source, Keyed) else ScriptedArrays(source)
