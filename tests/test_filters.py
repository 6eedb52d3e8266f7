"""Filters on simulated series: they follow the truth, repeat exactly, and survive odd input."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from murmuration.operators.filters import FilterConfig, initial, run_filter, run_imm, run_scheme, weighed
from murmuration.operators.models import BenchmarkModel
from murmuration.operators.resample import ONE
from murmuration.operators.stats import histogram, weighted_quantiles
from murmuration.sources.simulate import benchmark_series, garch_series
from murmuration.streaming.online import OnlineFilter

CONFIG = FilterConfig(particles=200, seed=5)


@pytest.fixture(scope="module")
def series(spark):
    return benchmark_series(spark, 3, 4, seed=2).cache()


def test_bootstrap_follows_and_repeats(spark, series):
    one = {(r["series_id"], r["t"]): r["mean"] for r in run_filter(series, config=CONFIG).collect()}
    two = {(r["series_id"], r["t"]): r["mean"] for r in run_filter(series.repartition(3), config=CONFIG).collect()}
    assert one.keys() == two.keys() and len(one) == 12
    assert all(abs(one[k] - two[k]) < 1e-9 for k in one)
    truth = {(r["series_id"], r["t"]): r["x"] for r in series.collect()}
    # the observation hides the sign of x, so its size is compared
    error = sum((abs(one[k]) - abs(truth[k])) ** 2 for k in truth) / len(truth)
    assert error < sum(x * x for x in truth.values()) / len(truth)


@pytest.mark.parametrize("model,filter_", [("growth", "auxiliary"), ("benchmark", "auxiliary"), ("growth", "bootstrap")])
def test_other_pairs_run(spark, series, model, filter_):
    out = run_filter(series.where("t <= 2"), model, filter_, CONFIG).collect()
    assert len(out) == 6 and all(1 <= r["ess"] <= 200 and r["q05"] <= r["q95"] for r in out)


@pytest.mark.parametrize("change", [{"weight_on": "pre"}, {"accumulate": False}, {"ess_share": None}, {"resampler": "stratified"}, {"n_out": 50}])
def test_switches(spark, series, change):
    config = FilterConfig(**({"particles": 100, "seed": 1} | change))
    out = run_filter(series.where("t <= 2"), config=config).collect()
    assert len(out) == 6


def test_far_observation_gives_equal_weights(spark):
    seen = spark.createDataFrame([(0, 1, 1e200)], "series_id long, t int, y double")
    state = initial(seen, BenchmarkModel(), CONFIG)
    out = weighed(state, seen, 1, BenchmarkModel(), CONFIG)
    assert out.count() == 200 and out.where(F.col("w") == ONE).count() >= 1


def test_no_observations(spark):
    empty = spark.createDataFrame([], "series_id long, t int, y double")
    assert run_filter(empty).count() == 0


def test_imm(spark):
    truth = garch_series(spark, 2, 2, seed=3)
    assert truth.count() == 4
    out = run_imm(truth, FilterConfig(particles=41, seed=1)).collect()
    assert len(out) == 4
    for r in out:
        assert 0 <= r["prob_mode0"] <= 1 and 1 <= r["ess"] <= 41 + 1e-6
        assert r["p3"] >= 0 and r["p3"] + r["p4"] <= 1 + 1e-9 and r["p1"] >= 0


def test_online_equals_batch(spark, series, tmp_path):
    where = str(tmp_path / "stream")
    for t in (1, 2, 3):
        series.where(F.col("t") == t).select("series_id", "t", "y").coalesce(1).write.mode("append").parquet(where)
    stream = spark.readStream.schema("series_id long, t int, y double").parquet(where)
    online = OnlineFilter(spark, config=CONFIG, path=str(tmp_path / "online"))
    query = online.start(stream)
    query.awaitTermination()
    found = {(r["series_id"], r["t"]): r["mean"] for r in online.summaries().collect()}
    wanted = {(r["series_id"], r["t"]): r["mean"] for r in run_filter(series.where("t <= 3"), config=CONFIG).collect()}
    assert found.keys() == wanted.keys()
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)
    again = OnlineFilter(spark, config=CONFIG, path=str(tmp_path / "online"))
    assert again.last_step == 3


def test_histogram_and_quantiles(spark):
    df = spark.createDataFrame([(float(i), 1) for i in range(100)], "x double, w long")
    bins = histogram(df, "x", "w", 10).collect()
    assert len(bins) == 10 and abs(sum(b["density"] for b in bins) * 9.9 - 1) < 1e-9
    q = {r["prob"]: r["value"] for r in weighted_quantiles(df, "x", "w", [0.05, 0.5]).collect()}
    assert q == {0.05: 4.0, 0.5: 49.0}
    assert histogram(df.where("x = 3"), "x", "w", 10).count() == 1


@pytest.mark.parametrize("scheme", ["cen", "dist1", "sub"])
def test_partitioned_runs(spark, series, scheme):
    one = series.where("series_id = 0 and t <= 2").select("t", "y")
    start = spark.range(400).selectExpr("id", "cast(id % 4 as int) part", "cast(id as double) / 40 - 5 as x")
    state, said = run_scheme(start, one, scheme, BenchmarkModel(), FilterConfig(parts=4, seed=2))
    assert state.count() == 400 and {r["t"] for r in said.collect()} == {1, 2}
    assert state.select("part").distinct().count() <= 4


def test_quantiles_of_a_large_group_are_exact(spark, monkeypatch):
    from pyspark.sql import functions as F

    from murmuration.operators import stats

    df = spark.range(30_000).select((F.col("id") % 3).alias("k"), F.floor(F.pow(F.rand(3), 4) * 5000).alias("x").cast("double")).where("k < 2 or x > 4000").cache()
    wanted = {r["k"]: (r["q05"], r["q95"]) for r in df.groupBy("k").agg(*stats.quantile_band("x")).collect()}
    monkeypatch.setattr(stats, "SMALL_GROUP", 5_000)
    assert df.groupBy("k").count().where("count > 5000").count() == 2
    found = {r["k"]: (r["q05"], r["q95"]) for r in stats.banded(df, "x", ["k"]).collect()}
    assert found.keys() == wanted.keys()
    assert all(found[k] == pytest.approx(wanted[k]) for k in wanted)


def test_weighted_quantiles_beside_an_outlier(spark):
    """Two far values leave the others in stretches of their own; nulls and rows without weight do not count."""
    plain = sorted([(float(i % 997) / 7, 1 + i % 5) for i in range(5000)] + [(1e300, 1), (-1e300, 1)])
    rows = plain + [(None, 10**6), (3.0, 0)]
    total, probs = sum(w for _, w in plain), [0.0, 0.05, 0.5, 0.95, 1.0]
    sums = list(itertools.accumulate(w for _, w in plain))
    expected = {p: next(x for (x, _), c in zip(plain, sums, strict=True) if c >= p * total) for p in probs}
    df = spark.createDataFrame(rows, "x double, w long")
    assert {r["prob"]: r["value"] for r in weighted_quantiles(df, "x", "w", probs).collect()} == expected
    assert weighted_quantiles(df.where("false"), "x", "w", probs).count() == 0
    one = spark.createDataFrame([(5.0, 2), (float("nan"), 1)], "x double, w long")
    found = {r["prob"]: r["value"] for r in weighted_quantiles(one, "x", "w", [0.5, 1.0]).collect()}
    assert found[0.5] == 5.0 and math.isnan(found[1.0])
