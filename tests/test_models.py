"""Model expressions against plain Python, and priors against their moments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from murmuration.functions import rng
from murmuration.operators.filters import FilterConfig, run_filter
from murmuration.operators.models import BenchmarkModel, GrowthModel, GuidedGrowthModel, RsGarch, constrained
from murmuration.sources.simulate import benchmark_series


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_benchmark(spark):
    m, x = BenchmarkModel(), 1.5
    mean = x / 2 + 25 * x / (1 + x * x) + 8 * math.cos(1.2 * 3)
    assert math.isclose(value(spark, m.mean(F.lit(x), F.lit(3.0))), mean)
    assert math.isclose(value(spark, m.propagate(F.lit(x), F.lit(3.0), F.lit(2.0))), mean + 2 * math.sqrt(10))
    assert math.isclose(value(spark, m.likelihood(0.2, F.lit(x))), math.exp(-0.5 * (0.2 - x * x / 20) ** 2) / math.sqrt(2 * math.pi))
    assert math.isclose(value(spark, m.log_likelihood(0.2, F.lit(x))), math.log(value(spark, m.likelihood(0.2, F.lit(x)))))
    assert math.isclose(value(spark, m.observe(F.lit(x), F.lit(0.5))), x * x / 20 + 0.5)


def test_growth_lags_its_density(spark):
    x, t = 0.7, 4.0
    expected = (x - 1) / 2 + 25 * x / (1 + x * x) + 8 * math.cos(1.2 * (t - 1))
    assert math.isclose(value(spark, GrowthModel().mean(F.lit(x), F.lit(t))), expected)
    moved = value(spark, GrowthModel().propagate(F.lit(x), F.lit(t), F.lit(0.0)))
    assert math.isclose(moved, value(spark, GrowthModel(density_lag=0).mean(F.lit(x), F.lit(t))))


def test_garch(spark):
    p = lambda k: F.lit([0.1, 0.2, 0.3, 0.05, 0.6, 0.4, -0.3, -0.5, 0.2][k])
    vol = 0.3 + 0.05 * (0.5 - 0.1) ** 2 + 0.6 * 0.8
    assert math.isclose(value(spark, RsGarch.volatility(F.lit(0.5), F.lit(0.8), F.lit(1), p)), vol)
    stay0, stay1 = 1 / (1 + math.exp(0.4 - 0.5 * 0.8)), 1 / (1 + math.exp(-0.3 + 0.2 * 0.8))
    m = RsGarch()
    for to, before, wanted in ((0, 0, stay0), (1, 0, 1 - stay0), (1, 1, stay1), (0, 1, 1 - stay1)):
        assert math.isclose(value(spark, m.mode_probability(to, F.lit(before), F.lit(0.8), p)), wanted)


def test_constraints(spark):
    row = spark.range(1).select(*constrained(F.lit(-0.5), F.lit(1.5), F.lit(-1.0), F.lit(2.0))).first()
    assert tuple(row) == (0.0, 2.0, 0.0, 1.0)


def test_priors_have_their_moments(spark):
    rows = spark.range(40_000).select(*RsGarch.init_state("id", seed=1), RsGarch.init_mode(0.3, "id", seed=1).alias("q"), *RsGarch.init_parameters("id", seed=1))
    m = rows.agg(*[F.avg(c).alias(c) for c in rows.columns], F.max(F.col("p3") + F.col("p4")).alias("top"), F.min(F.col("p2") - F.col("p1")).alias("gap")).first()
    assert abs(m["r"]) < 0.03 and abs(m["vol"] - 2 / 7) < 0.01 and abs(m["q"] - 0.7) < 0.02
    assert abs(m["p0"]) < 0.03 and abs(m["p3"] - 0.1) < 0.01 and m["top"] <= 1 and m["gap"] >= 0
    assert abs((m["p1"] + m["p2"]) / 2 - 0.4) < 0.02
    for k, shift in zip((5, 6, 7, 8), (0, -10, -5, 10), strict=True):
        assert abs(m[f"p{k}"] - shift) < 0.05


def test_draws_depend_on_keys_alone(spark):
    draw = lambda df: {r["id"]: r["z"] for r in df.select("id", rng.normal("id", seed=2).alias("z")).collect()}
    assert draw(spark.range(0, 500, 1, 2)) == draw(spark.range(0, 500, 1, 7))
    u = spark.range(20_000).agg(F.min(rng.uniform("id")), F.max(rng.uniform("id"))).first()
    assert u[0] > 0 and u[1] < 1


def test_guided_weights_against_plain_numbers():
    """The step's log weight is likelihood * transition / proposal, and the proposal is the exact posterior of the linearised observation."""
    model, before, y, t, z = GuidedGrowthModel(), 1.7, 6.0, 3.0, 0.4
    m = (before - 1) / 2 + 25 * before / (1 + before**2) + 8 * math.cos(1.2 * t)
    mean, sd = model.pulled(before, y, t)
    # the posterior of N(m, 10) under y = m^2/20 + m/10 (x - m) + e, by a fine sum
    x = np.linspace(m - 40, m + 40, 400_001)
    density = np.exp(-((x - m) ** 2) / 20 - (y - m * m / 20 - m / 10 * (x - m)) ** 2 / 2)
    density /= density.sum()
    assert mean == pytest.approx((x * density).sum(), abs=1e-6)
    assert sd == pytest.approx(math.sqrt((x * x * density).sum() - (x * density).sum() ** 2), abs=1e-5)
    moved = model.proposal(before, y, t, z)
    pdf = lambda v, mu, s: math.exp(-((v - mu) ** 2) / (2 * s * s)) / (s * math.sqrt(2 * math.pi))
    assert moved == pytest.approx(mean + sd * z)
    assert model.log_transition(moved, before, t) == pytest.approx(math.log(pdf(moved, m, math.sqrt(10))))
    assert model.log_proposal(moved, before, y, t) == pytest.approx(math.log(pdf(moved, mean, sd)))
    assert math.exp(model.log_proposal(moved, before, y, t)) == pytest.approx(model.proposal_pdf(moved, before, y, t))


def test_guided_particles_keep_larger_sets(spark):
    """On series of the growth variant the guided filter's effective size is above the plain one's, by matrix and by row alike, and its means are as near."""
    truth = benchmark_series(spark, 6, 12, seed=5, model=GrowthModel(density_lag=0)).cache()
    seen = truth.select("series_id", F.col("t").cast("int").alias("t"), "y")
    config = FilterConfig(particles=500, seed=3, ess_share=None)
    said = {name: {(r["series_id"], r["t"]): r for r in run_filter(seen, name, "bootstrap", config).collect()} for name in ("guided", "growth")}
    sizes = {name: sum(r["ess"] for r in rows.values()) / len(rows) for name, rows in said.items()}
    assert sizes["guided"] > 1.2 * sizes["growth"]
    away = sum(abs(said["guided"][k]["mean"] - said["growth"][k]["mean"]) for k in said["growth"]) / len(said["growth"])
    assert away < 0.5
    few = seen.where("t <= 2 and not (series_id = 0 and t = 1)")
    by_row = {(r["series_id"], r["t"]): r for r in run_filter(few, "guided", "bootstrap", FilterConfig(particles=20, packed=0)).collect()}
    for k, r in {(r["series_id"], r["t"]): r for r in run_filter(few, "guided", "bootstrap", FilterConfig(particles=20)).collect()}.items():
        assert all(by_row[k][c] == pytest.approx(r[c], rel=1e-9) for c in ("mean", "ess", "q05", "q95")), k
