"""Long simulated series, and the store of observations by ranges of steps."""

import math
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from murmuration.functions.rng import Keyed, Scripted
from murmuration.operators.models import BenchmarkModel, GrowthModel
from murmuration.sources import stretches
from murmuration.sources.steps import read_steps, write_observations
from murmuration.sources.stretches import long_garch, long_series

STARTS = "series_id long, x double, other string"
GARCH = {"r": 0.3, "vol": 0.5, "q": 1, "p0": 0.1, "p1": 0.2, "p2": 0.4, "p3": 0.2, "p4": 0.5, "p5": 0.0, "p6": -1.0, "p7": -2.0, "p8": 1.0}


@pytest.mark.parametrize("source", [Keyed(3), Scripted(3)], ids=["keyed", "scripted"])
@pytest.mark.parametrize("model", [BenchmarkModel(), GrowthModel()], ids=["benchmark", "growth"])
def test_a_series_is_the_model_step_by_step(spark, source, model, monkeypatch):
    """Against noise drawn as Columns and plain arithmetic; stretches of two steps, a repeated start and rows that are left out."""
    monkeypatch.setattr(stretches, "ROWS", 8)
    rows = [(1, 0.5, "a"), (2, -3.0, None), (2, -3.0, "b"), (3, None, "c"), (None, 1.0, "d")]
    starts = spark.createDataFrame(rows, STARTS)
    found = sorted(map(tuple, long_series(starts, model, 7, source, dt=0.5).collect()))
    drawn = spark.createDataFrame([(i,) for i in (1, 2)], "series_id long").select("series_id", *[source.normal(name, t, "series_id").alias(f"{name}{t}") for name in ("move", "observe") for t in range(1, 8)])
    noise = {r["series_id"]: r for r in drawn.collect()}
    wanted = []
    for i, x, copies in ((1, 0.5, 1), (2, -3.0, 2)):
        for t in range(1, 8):
            x = (x - model.shift) / 2 + 25 * x / (1 + x * x) + 8 * math.cos(1.2 * t * 0.5) + math.sqrt(10) * noise[i][f"move{t}"]
            wanted += copies * [(i, t, x, x * x / 20 + noise[i][f"observe{t}"])]
    assert len(found) == len(wanted)
    for a, b in zip(found, sorted(wanted), strict=True):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_a_garch_series_is_the_model_step_by_step(spark):
    source, steps = Scripted(5), 9
    names = list(GARCH)
    starts = spark.createDataFrame([(7, *GARCH.values()), (8, *[None if c == "vol" else v for c, v in GARCH.items()])], "series_id long, " + ", ".join(f"{c} {'int' if c == 'q' else 'double'}" for c in names))
    found = long_garch(starts, steps, source).orderBy("t").collect()
    u = spark.range(1).select(*[source.uniform("mode", t, F.lit(7)).alias(f"u{t}") for t in range(1, steps + 1)], *[source.normal(n, t, F.lit(7)).alias(f"{n}{t}") for n in ("move", "observe") for t in range(1, steps + 1)]).first()
    r, vol, q, p = GARCH["r"], GARCH["vol"], GARCH["q"], [GARCH[f"p{k}"] for k in range(9)]
    assert [row["t"] for row in found] == list(range(1, steps + 1)) and {row["series_id"] for row in found} == {7}
    for row in found:
        t = row["t"]
        stay = 1 / (1 + math.exp(p[5 + q] + p[7 + q] * vol))
        q = q if u[f"u{t}"] < stay else 1 - q
        vol = p[1 + q] + p[3] * (r - p[0]) ** 2 + p[4] * vol
        r = p[0] + math.sqrt(vol) * u[f"move{t}"]
        assert row["q"] == q and (row["vol"], row["r"], row["y"]) == pytest.approx((vol, r, r + u[f"observe{t}"]))


def test_time_is_linear_in_steps(spark):
    """100,000 steps; the last value of a shorter run is a value of the longer one, and no series is held whole."""
    starts = spark.createDataFrame([(i, float(i), None) for i in range(4)], STARTS)
    took = {}
    for steps in (10_000, 100_000):
        began = time.perf_counter()
        out = long_series(starts, BenchmarkModel(), steps, Scripted(1)).groupBy("series_id").agg(F.count("*").alias("n"), F.max_by("x", F.when(F.col("t") <= 10_000, F.col("t"))).alias("x")).orderBy("series_id").collect()
        took[steps] = time.perf_counter() - began
        assert [r["n"] for r in out] == 4 * [steps]
        at = [r["x"] for r in out] if steps == 10_000 else at  # noqa: F821
    assert at == [r["x"] for r in out]
    assert took[100_000] < 25 * took[10_000]


def test_no_series_and_no_steps(spark):
    starts = spark.createDataFrame([(1, 1.0, None)], STARTS)
    assert long_series(starts.where("false"), BenchmarkModel(), 3).count() == long_series(starts, BenchmarkModel(), 0).count() == 0


def test_other_folders_are_not_read(spark, tmp_path):
    """Every other folder is spoilt; the steps of one are read all the same, with files of two widths."""
    path = str(tmp_path / "store")
    rows = [(i, t, float(10 * i + t), "more") for i in range(5) for t in range(1, 31)] + [(9, 12, None, None), (None, 12, 1.0, "x"), (4, None, 2.0, "y")]
    seen = spark.createDataFrame(rows, "series_id long, t int, y double, more string")
    write_observations(seen.where("t <= 15 or t is null"), path, width=5, files=3)
    write_observations(seen.where("t > 15"), path, width=7, files=2)
    wanted = {(r[0], r[1], r[2], r[3]) for r in rows if r[1] in (12, 13)}
    for file in Path(path).rglob("*.parquet"):
        if "span=10" not in str(file):
            file.write_bytes(b"spoilt")
    for crc in Path(path).rglob(".*.crc"):
        crc.unlink()
    found = read_steps(spark, path, 12, 13, seen.schema)
    assert found.columns == seen.columns
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == len(wanted)


def test_steps_of_a_store(spark, tmp_path):
    path = str(tmp_path / "store")
    seen = spark.createDataFrame([(1, t, float(t)) for t in range(1, 23)] + [(1, 4, 4.0)], "series_id long, t int, y double")
    write_observations(seen, path, width=4)
    for low, high in ((4, None), (1, 22), (3, 9), (22, 40), (30, None)):
        wanted = sorted(r["t"] for r in seen.collect() if low <= r["t"] <= (high or low))
        assert sorted(r["t"] for r in read_steps(spark, path, low, high).collect()) == wanted
    with pytest.raises(ValueError):
        write_observations(seen.withColumn("Span", F.lit(1)), path)
    with pytest.raises(ValueError):
        write_observations(seen, path, width=0)


def test_one_step_of_very_many_series_is_many_files(spark, tmp_path):
    """All rows in one step: range bounds by series, so that no task writes them all."""
    path = str(tmp_path / "hot")
    write_observations(spark.range(20_000).selectExpr("id as series_id", "1 as t", "double(id) as y"), path, files=4)
    sizes = [r["n"] for r in read_steps(spark, path, 1).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < 10_000
