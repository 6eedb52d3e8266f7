"""Random numbers as a function of keys.

A draw depends on its keys, a seed and a tag alone, so a task that runs again,
or other partitions, give the same numbers, and no two rows share a stream.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def _tagged(tag, end: str):
    return tag + end if isinstance(tag, str) else F.concat(tag, F.lit(end))


def uniform(*keys, seed: int | Column = 0, tag: str | Column = "u") -> Column:
    """Uniform on the open interval (0, 1), from 53 bits of a hash."""
    h = F.xxhash64(F.lit(seed) if isinstance(seed, int) else seed, F.lit(tag) if isinstance(tag, str) else tag, *[_col(k) for k in keys])
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def normal(*keys, seed: int | Column = 0, tag: str | Column = "n") -> Column:
    """Standard normal by Box and Muller's transform."""
    u, v = (uniform(*keys, seed=seed, tag=_tagged(tag, k)) for k in "ab")
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)


# Coefficients of Acklam's rational approximation to the inverse of the normal distribution.
_MIDDLE = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
_MIDDLE_BELOW = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
_TAIL = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
_TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
_TAIL_FROM = 0.02425


def _polynomial(coefficients, x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def probit(p: Column) -> Column:
    """Inverse of the standard normal distribution function, to about 1e-9."""
    tail = F.least(p, 1.0 - p)
    far = F.sqrt(-2.0 * F.log(tail))
    outside = _polynomial(_TAIL, far) / _polynomial(_TAIL_BELOW, far)
    q = p - 0.5
    middle = q * _polynomial(_MIDDLE, q * q) / _polynomial(_MIDDLE_BELOW, q * q)
    return F.when(tail >= _TAIL_FROM, middle).when(p < 0.5, outside).otherwise(-outside)


def _once(x: Column, f) -> Column:
    """f of a column that is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), 0)


def _from(source, keys, seed: int, tag: str) -> Column:
    """The uniform that a distribution is drawn from: of a source of noise, or of a seed."""
    return uniform(*keys, seed=seed, tag=tag) if source is None else source.uniform(tag, 0, *keys)


def truncated_normal(bound: float, *keys, seed: int = 0, tag: str = "tn", source=None) -> Column:
    """Standard normal on (-bound, bound), by its inverse distribution function."""
    below = 0.5 * math.erfc(bound / math.sqrt(2))
    p = below + (1 - 2 * below) * _from(source, keys, seed, tag)
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), _once(p, probit)))


def gamma2(scale: float, *keys, seed: int = 0, tag: str = "g", source=None) -> Column:
    """Gamma of shape 2: the sum of two exponentials."""
    u, v = (_from(source, keys, seed, f"{tag}{k}") for k in "ab")
    return -F.lit(scale) * F.log(u * v)


def beta_1(b: float, *keys, seed: int = 0, tag: str = "b1", source=None) -> Column:
    """Beta(1, b) by its inverse distribution function."""
    return 1.0 - F.pow(_from(source, keys, seed, tag), F.lit(1.0 / b))


def beta_to(a: float, upper, *keys, seed: int = 0, tag: str = "ba", source=None) -> Column:
    """Beta(a, 1) cut off at ``upper``."""
    return _col(upper) * F.pow(_from(source, keys, seed, tag), F.lit(1.0 / a))


def beta_2_5(*keys, seed: int = 0, tag: str = "b25", source=None) -> Column:
    """Beta(2, 5): the second smallest of six uniforms."""
    return F.get(F.array_sort(F.array(*[_from(source, keys, seed, f"{tag}{k}") for k in range(6)])), 1)


def laplace(*keys, seed: int = 0, tag: str = "l", source=None) -> Column:
    return _once(_from(source, keys, seed, tag) - 0.5, lambda u: -F.signum(u) * F.log(1.0 - 2.0 * F.abs(u)))


def lcg(i) -> Column:
    """A linear congruential value in [0, 1) that any SQL engine gives alike."""
    return (_col(i).cast("long") * 1103515245 + 12345) % 2147483648 / F.lit(2147483648.0)


@dataclass(frozen=True)
class Keyed:
    """Noise of a run from hashes of its name, step and keys."""

    seed: int = 0

    def normal(self, name: str, t: int | Column, *keys) -> Column:
        return normal(*keys, seed=self.seed, tag=self._tag(name, t))

    def uniform(self, name: str, t: int | Column, *keys) -> Column:
        return uniform(*keys, seed=self.seed, tag=self._tag(name, t))

    @staticmethod
    def _tag(name, t):
        return f"{name}{t}" if isinstance(t, int) else F.concat(F.lit(name), t.cast("string"))


#: Integers of the scripted noise are under this prime.
RANGE = (1 << 31) - 1
#: Keys enter it linearly and are mixed by a square for each of these.
SQUARES = (40014, 80028)
#: A further square gives the second number of a normal draw.
SECOND = 120042


@dataclass(frozen=True)
class Scripted:
    """Noise from integer arithmetic alone, which any SQL engine repeats to the last bit.

    ``normal`` adds four uniforms and scales them to variance 1, so it needs no
    logarithm or cosine and lies within 3.5.
    """

    seed: int = 0

    @staticmethod
    def constant(name: str) -> int:
        return zlib.crc32(name.encode()) % RANGE

    def hashed(self, name: str, t, *keys) -> Column:
        h = F.lit((self.seed + self.constant(name)) % RANGE).cast("long")
        for k in (t, *keys):
            h = (h * 48271 + _col(k).cast("long")) % RANGE
        for add in SQUARES:
            h = (h * h + add) % RANGE
        return h

    def uniform(self, name: str, t, *keys) -> Column:
        return (self.hashed(name, t, *keys) + 0.5) / float(RANGE)

    def normal(self, name: str, t, *keys) -> Column:
        def of(a):
            b = (a * a + SECOND) % RANGE
            total = F.shiftright(a, 16) + a.bitwiseAND(low) + F.shiftright(b, 16) + b.bitwiseAND(low)
            return ((total + 2) / 32768.0 - 2.0) * math.sqrt(3.0)

        low = F.lit((1 << 15) - 1).cast("long")
        return F.get(F.transform(F.array(self.hashed(name, t, *keys)), of), 0)  # hashed once


#: Sources of noise by name.
NOISE = {"keyed": Keyed, "scripted": Scripted}
