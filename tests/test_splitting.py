"""Multinomial counts by splitting: binomial numbers against their distribution, counts against weights."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions.rng import Keyed, Scripted
from murmuration.operators import splitting
from murmuration.operators.splitting import allocated_by_splitting, binomial, multinomial_by_splitting, split_counts


@pytest.mark.parametrize("n,p", [(0, 0.5), (1, 0.3), (2, 0.5), (7, 0.9), (15, 0.01), (16, 0.999), (40, 0.37), (1000, 0.2), (3, 0.0), (5, 1.0)])
def test_binomial_numbers_have_their_distribution(n, p):
    u = (np.arange(100_000) + 0.5) / 100_000
    found = np.bincount(binomial(np.full(u.size, n), np.full(u.size, p), u), minlength=n + 1) / u.size
    wanted = [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]
    assert found == pytest.approx(wanted, abs=1.1e-5)


def test_very_large_numbers():
    n, p = 10**10, 0.3
    found = binomial(np.full(400, n), np.full(400, p), (np.arange(400) + 0.5) / 400)
    z = (found - n * p) / math.sqrt(n * p * (1 - p))
    assert abs(z.mean()) < 0.01 and abs(z.std() - 1) < 0.02 and np.abs(z).max() < 4.5


@pytest.mark.parametrize("source", [Keyed(4), Scripted(4)], ids=["keyed", "scripted"])
def test_counts_follow_weights(spark, source):
    """5,000 numbers with gaps over two tiers of the tree; chi-square over all rows, and n is dealt whole."""
    rows = spark.range(5000).select((F.col("id") * 7).alias("id"), (F.col("id") % 5).alias("w"), F.lit("x").alias("other"))
    n = 60_000
    out = multinomial_by_splitting(rows, n, source).collect()
    assert len(out) == 5000 and sum(r["cnt"] for r in out) == n and out[0].asDict().keys() == {"id", "w", "other", "cnt"}
    assert all(r["cnt"] == 0 for r in out if r["w"] == 0)
    total = sum(r["w"] for r in out)
    chi = sum((r["cnt"] - n * r["w"] / total) ** 2 / (n * r["w"] / total) for r in out if r["w"])
    assert abs(chi - 3999) < 6 * math.sqrt(2 * 3999)
    again = split_counts(rows.repartition(7), n, source)
    assert {r["id"]: r["cnt"] for r in again.collect()} == {r["id"]: r["cnt"] for r in out if r["cnt"]}


def test_counts_of_sub_filters_repeat_with_their_variance():
    """Many steps of one split: means and covariances of a multinomial."""
    source, weights = Scripted(8), np.zeros(1 << splitting.BITS, np.int64)
    weights[:3] = 5, 3, 2
    noise = splitting.arrays_of(source)
    found = np.array([splitting._split(weights, 100, 0, 0, noise, "split", t)[:4] for t in range(1500)])
    p = np.array([0.5, 0.3, 0.2, 0.0])
    assert (found.sum(axis=1) == 100).all()
    assert found.mean(axis=0) == pytest.approx(100 * p, abs=0.6)
    assert np.cov(found.T) == pytest.approx(100 * (np.diag(p) - np.outer(p, p)), abs=3.0)


def test_odd_tables(spark):
    schema = "part int, w long"
    one = allocated_by_splitting(spark.createDataFrame([(3, 9), (3, 1)], schema), 12, Scripted(1)).collect()
    assert [(r["part"], r["w"], r["cnt"]) for r in one] == [(3, 10, 12)]
    none = spark.createDataFrame([(0, 0), (1, None)], schema)
    assert all(r["cnt"] == 0 for r in allocated_by_splitting(none, 5, Scripted(1)).collect())
    rows = spark.createDataFrame([(0, 4), (None, 3), (1, -2), (2, None), (3, 4)], "id long, w long")
    assert split_counts(rows.where("false"), 5, Keyed(1)).count() == split_counts(rows, 0, Keyed(1)).count() == 0
    assert {r["id"] for r in split_counts(rows, 1000, Keyed(1)).collect()} == {0, 3}
    with pytest.raises(ValueError):
        split_counts(spark.createDataFrame([(-1, 4)], "id long, w long"), 5, Keyed(1))
