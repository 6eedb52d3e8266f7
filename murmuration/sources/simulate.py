"""Simulated series: the fold of a model over time, one array expression per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rng
from ..operators.models import BenchmarkModel, RsGarch


def simulated(series: DataFrame, model: BenchmarkModel, steps: int, start: Column, noise, dt: float = 1.0) -> DataFrame:
    """``series_id, t, x, y`` for t = 1..steps from ``start``.

    ``noise(t, kind)`` gives the k-th noise Column for ``kind`` "x" or "y".
    Series run in parallel; a series is one fold, as each step needs the last.
    """
    first = F.array(start)

    def step(states, t):
        before = F.element_at(states, -1)
        return F.concat(states, F.array(model.propagate(before, t * dt, noise(t, "x"))))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)
    out = series.select("*", F.posexplode(path).alias("t", "x")).where("t > 0")
    return out.withColumn("y", model.observe(F.col("x"), noise(F.col("t"), "y")))


def benchmark_series(spark, n: int, steps: int, seed: int = 0, model: BenchmarkModel | None = None) -> DataFrame:
    """n series with keyed noise."""
    model = model or BenchmarkModel()
    series = spark.range(n).withColumnRenamed("id", "series_id")
    noise = lambda t, kind: rng.normal("series_id", t, seed=seed, tag=kind)
    return simulated(series, model, steps, model.init(rng.normal("series_id", seed=seed, tag="x0")), noise).select("series_id", "t", "x", "y")


def garch_series(spark, n: int, steps: int, seed: int = 0, p0: float = 1.0) -> DataFrame:
    """``series_id, t, r, vol, q, y, p0..p8``: mode first, then volatility and return, then the observation."""
    model = RsGarch()
    series = spark.range(n).withColumnRenamed("id", "series_id")
    series = series.select("series_id", *model.init_state("series_id", seed=seed), model.init_mode(p0, "series_id", seed=seed).alias("q"), *model.init_parameters("series_id", seed=seed))
    p = lambda k: F.col(f"p{k}")

    def step(states, t):
        s = F.element_at(states, -1)
        q = model.next_mode(s["q"], s["vol"], p, rng.uniform("series_id", t, seed=seed, tag="mode"))
        r, vol = model.propagate(s["r"], s["vol"], q, p, rng.normal("series_id", t, seed=seed, tag="r"))
        return F.concat(states, F.array(F.struct(r.alias("r"), vol.alias("vol"), q.cast("int").alias("q"))))

    first = F.array(F.struct("r", "vol", F.col("q").cast("int").alias("q")))
    path = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, step)
    flat = series.select("series_id", *[f"p{k}" for k in range(9)], F.posexplode(path).alias("t", "s")).where("t > 0")
    y = model.observe(F.col("s.r"), rng.normal("series_id", "t", seed=seed, tag="y"))
    return flat.select("series_id", "t", "s.r", "s.vol", "s.q", y.alias("y"), *[f"p{k}" for k in range(9)])
