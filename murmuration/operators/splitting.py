"""Multinomial counts without draws: n is split over a binary tree of weights by conditional binomials.

A node's count goes to its left half by a binomial draw with the left half's
share of the weight, so P counts cost P - 1 numbers whatever n is, and nothing
of the size of n is made or shuffled. A draw belongs to its node, so counts
depend neither on partitions nor on how the tree is cut into tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.noise_arrays import arrays_of
from ..functions.rng import Keyed, Scripted

#: Levels of the tree in a task.
BITS = 12
#: Probabilities that are looked at together.
CELLS = 1 << 14
#: ln(k!) less its leading terms, for k = 0..15.
_SMALL = np.array([0.0] + [math.lgamma(k + 1) - (k + 0.5) * math.log(k) + k - 0.5 * math.log(2 * math.pi) for k in range(1, 16)])


def _rest(k: np.ndarray) -> np.ndarray:
    """What Stirling's formula leaves of ln(k!)."""
    k = np.asarray(k, float)
    large = np.maximum(k, 16.0)
    series = (1 / 12 - (1 / 360 - 1 / 1260 / (large * large)) / (large * large)) / large
    return np.where(k < 16, _SMALL[np.minimum(k, 15).astype(int)], series)


def _about(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """k ln(k / mean) + mean - k, without cancellation for k near the mean."""
    away = (k - mean) / mean
    return mean * ((1 + away) * np.log1p(away) - away)


def _at_mode(n: np.ndarray, p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The binomial probability of k, which lies at the mode, for 0 < p < 1 and n > 0."""
    inner = np.clip(k, 1, np.maximum(n - 1, 1)).astype(float)
    other = np.maximum(n - inner, 1.0)
    with np.errstate(all="ignore"):
        found = np.exp(_rest(n) - _rest(inner) - _rest(other) - _about(inner, n * p) - _about(other, n * (1 - p))) * np.sqrt(n / (2 * math.pi * inner * other))
        return np.where(k == 0, np.exp(n * np.log1p(-p)), np.where(k == n, np.exp(n * np.log(p)), found))


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Binomial numbers from uniforms: u is used up by probabilities from the mode outwards, right before left.

    Steps are of the order of the standard deviation. Only ratios of
    neighbours follow the mode's probability, so very large n lose nothing.
    """
    n, p, rest = n.astype(np.int64), np.asarray(p, float), np.array(u, float)
    mode = np.clip(np.floor((n + 1) * p), 0, n).astype(np.int64)
    out = np.where(p >= 1, n, np.where(p <= 0, 0, mode))
    at = np.flatnonzero((n > 0) & (p > 0) & (p < 1))
    n, p, mode = n[at], p[at], mode[at]
    right = _at_mode(n, p, mode)
    left, rest, odds = right.copy(), rest[at] - right, p / (1 - p)
    done = 0
    while True:
        going = (rest >= 0) & ((mode + done < n) | (mode - done > 0))
        at, n, mode, right, left, rest, odds = (a[going] for a in (at, n, mode, right, left, rest, odds))
        if not at.size:
            return out
        j = done + np.arange(1, max(8, min(1024, CELLS // at.size)) + 1)[None, :]
        wide, middle = n[:, None], mode[:, None]
        rights = right[:, None] * np.cumprod(np.maximum(wide - middle - j + 1, 0) / (middle + j) * odds[:, None], axis=1)
        lefts = left[:, None] * np.cumprod(np.maximum(middle - j + 1, 0) / (wide - middle + j) / odds[:, None], axis=1)
        used = np.cumsum(np.stack([rights, lefts], axis=2).reshape(at.size, -1), axis=1)
        over = used > rest[:, None]
        hit = over.any(axis=1)
        first = np.argmax(over, axis=1)
        away = done + first // 2 + 1
        out[at[hit]] = np.where(first % 2, mode - away, mode + away)[hit]
        right, left, rest = rights[:, -1], lefts[:, -1], np.where(hit, -1.0, rest - used[:, -1])
        done += j.size


def _split(weights: np.ndarray, n: int, group: int, tier: int, noise, name: str, t: int) -> np.ndarray:
    """n over the 2**BITS leaves of one part of the tree."""
    levels = [weights]
    for _ in range(BITS):
        levels.append(levels[-1][0::2] + levels[-1][1::2])
    counts = np.array([n], np.int64)
    for down in range(BITS, 0, -1):
        total, left, given = levels[down], levels[down - 1][0::2], np.zeros(len(counts), np.int64)
        some = np.flatnonzero((counts > 0) & (total > 0))
        if some.size:
            level, place = np.full(some.size, tier * BITS + down, np.int64), (group << (BITS - down)) + some.astype(np.int64)
            share = left[some].astype(float) / total[some].astype(float)
            given[some] = binomial(counts[some], share, noise.uniform(name, t, level, place))
        counts = np.stack([given, np.where(total > 0, counts - given, 0)], axis=1).ravel()
    return counts


def split_counts(df: DataFrame, n: int, source: Keyed | Scripted, t: int = 0, w: str = "w", order: str = "id", name: str = "split") -> DataFrame:
    """``order, cnt`` for the rows of ``df`` that get some of n draws by weight; together they are n.

    ``order`` is a number from 0, of one row each, gaps allowed; weights are
    longs whose sum is under 2^63. Null or negative weights count as 0 and
    rows without a number are left out. Without weight there are no rows. A
    task takes 4,096 numbers, and the sums above them are tables 4,096 times
    smaller each.
    """
    place, weight = F.col(order).cast("long"), F.greatest(F.coalesce(F.col(w), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    leaves = df.where(F.col(order).isNotNull()).select(place.alias("place"), weight.alias("w")).where("w > 0")
    ends = leaves.agg(F.min("place").alias("low"), F.max("place").alias("high")).first()
    if (ends["low"] or 0) < 0:
        raise ValueError(f"{order} begins at 0")
    tiers = max(1, -(-int(ends["high"] or 0).bit_length() // BITS))

    def part(tier: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            group = int(rows["place"].iloc[0]) >> BITS
            weights = np.zeros(1 << BITS, np.int64)
            weights[rows["place"].to_numpy() & ((1 << BITS) - 1)] = rows["w"].to_numpy()
            counts = _split(weights, int(rows["n"].iloc[0]), group, tier, arrays_of(source), name, t)
            found = np.flatnonzero(counts)
            return pd.DataFrame({"place": (group << BITS) + found, "cnt": counts[found]})

        return run

    above = None
    for tier in range(tiers - 1, -1, -1):
        sums = leaves if tier == 0 else leaves.groupBy(F.shiftright("place", tier * BITS).alias("place")).agg(F.sum("w").alias("w"))
        sums = sums.withColumn("group", F.shiftright("place", BITS))
        dealt = sums.withColumn("n", F.lit(n).cast("long")) if above is None else sums.join(above.select(F.col("place").alias("group"), F.col("cnt").alias("n")), "group")
        above = dealt.groupBy("group").applyInPandas(part(tier), "place long, cnt long")
    return above.select(F.col("place").alias(order), "cnt")


def multinomial_by_splitting(df: DataFrame, n: int, source: Keyed | Scripted, t: int = 0, w: str = "w", order: str = "id") -> DataFrame:
    """``df`` with ``cnt``: the multinomial resampler for a large set, whose n draws are never made. Rows that get none have 0."""
    counts = split_counts(df, n, source, t, w, order).withColumnRenamed(order, "__place")
    return df.join(counts, F.col(order).cast("long") == F.col("__place"), "left").drop("__place").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def allocated_by_splitting(df: DataFrame, n: int, source: Keyed | Scripted, t: int = 0) -> DataFrame:
    """``part, w, cnt``: n multinomial draws over sub-filters by their weights, a number for each sub-filter."""
    sums = df.groupBy("part").agg(F.sum("w").alias("w"))
    return multinomial_by_splitting(sums, n, source, t, order="part").select("part", "w", "cnt")
