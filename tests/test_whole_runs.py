"""Whole runs take every event of every user."""

import datetime
from dataclasses import replace

import numpy as np
import pytest

from murmuration.operators.filters import FilterConfig, run_filter, run_imm, run_schemes
from murmuration.operators.models import BenchmarkModel, RsGarch
from murmuration.plans.running import MR_SCHEMES, MR_SIDE, QUERIES, SPARK_SCHEMES, SPARK_SIDE
from murmuration.streaming.online import OnlineFilter

LENGTHS = {1: 7, 2: 5, 3: 1}
CONFIG = FilterConfig(particles=40, seed=2)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("events"))
    start = datetime.datetime(2024, 1, 1)
    rows = [(100 * u + k, start + datetime.timedelta(hours=k), u, "view", float(10 * k + u), "") for u, n in LENGTHS.items() for k in range(n)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{where}/events.parquet")
    return where


@pytest.mark.parametrize("name", ["bootstrap_run", "apf_run", "aux_imm_run", "online_run", "live_run"])
def test_every_event_is_filtered(spark, events, name):
    found = sorted((r["series_id"], r["t"]) for r in QUERIES[name][0](spark, events).collect())
    assert found == [(u, t) for u, n in LENGTHS.items() for t in range(1, n + 1)]


def test_scheme_runs_take_every_step(spark, events):
    found = [r["t"] for r in QUERIES["scheme_runs"][0](spark, events).collect()]
    assert sorted(found) == sorted(6 * list(range(1, max(LENGTHS.values()) + 1)))


@pytest.mark.parametrize("side,change", [(SPARK_SIDE, {}), (MR_SIDE, {"noise": "keyed", "grid": None, "n_out": 90})], ids=["spark", "mapreduce"])
def test_runs_in_a_task_are_runs_step_by_step(spark, side, change):
    """All nine schemes under both families' switches; a set over the bound goes a job a step."""
    particles = spark.range(101).selectExpr("id * 3 as id", "cast(id % 4 as int) as part", "cast(id as double) / 10 - 5 as x")
    seen = spark.createDataFrame([(1, 1.0), (2, 3.0), (4, 0.5), (4, 9.0), (5, None)], "t int, y double")
    names = SPARK_SCHEMES + MR_SCHEMES
    runs = [{(r["scheme"], r["t"]): r for r in run_schemes(particles, seen, names, BenchmarkModel(), replace(side, **change, packed_run=bound)).collect()} for bound in (1 << 20, 0)]
    assert runs[0].keys() == runs[1].keys() == {(s, t) for s in names for t in (1, 2, 4)}
    for k, r in runs[0].items():
        assert all(runs[1][k][c] == pytest.approx(r[c], rel=1e-9) for c in ("mean", "ess")), k
    assert run_schemes(particles, seen.where("false"), names, BenchmarkModel(), side).count() == 0


@pytest.mark.parametrize("run", [lambda s: run_filter(s, "growth", "auxiliary", CONFIG), lambda s: run_imm(s, CONFIG)], ids=["auxiliary", "imm"])
def test_a_gap_does_not_end_a_series(spark, run):
    """Series 0 has a null y and series 1 no row at step 2; series 2 has all."""
    rows = [(i, t, None if (i, t) == (0, 2) else 1.0 + i + t) for i in range(3) for t in (1, 2, 3) if (i, t) != (1, 2)]
    seen = spark.createDataFrame(rows, "series_id long, t int, y double")
    out = {(r["series_id"], r["t"]): r for r in run(seen).collect()}
    assert out.keys() == {(i, t) for i in range(3) for t in (1, 2, 3)}
    for i in (0, 1):
        # a step without observation keeps the weights and moves the state
        assert out[i, 2]["ess"] == pytest.approx(out[i, 1]["ess"]) and out[i, 2]["mean"] != out[i, 1]["mean"]
        assert 1 <= out[i, 3]["ess"] <= 40 + 1e-6
    alone = {(r["series_id"], r["t"]): r for r in run(seen.where("series_id = 2")).collect()}
    assert all(alone[2, t]["mean"] == pytest.approx(out[2, t]["mean"]) for t in (1, 2, 3))


def test_a_slow_series_is_not_late(spark, tmp_path):
    """Batches in which one series runs ahead, one is behind, one comes later and one has a gap; a step that its own series has passed is late."""
    files = [[(0, 1), (0, 2), (0, 3), (1, 1), (3, 1)], [(1, 2), (2, 1), (2, 2), (0, 2), (3, 3)], [(1, 3), (0, 4), (2, 3)]]
    where, y = str(tmp_path / "stream"), lambda i, t: 1.0 + i + t
    online = None
    for keys in files:
        spark.createDataFrame([(i, t, y(i, t)) for i, t in keys], "series_id long, t int, y double").coalesce(1).write.mode("append").parquet(where)
        # each start takes what is new as a batch of its own, from the folder of the run before
        online = OnlineFilter(spark, config=CONFIG, path=str(tmp_path / "online"))
        online.start(spark.readStream.schema("series_id long, t int, y double").parquet(where)).awaitTermination()
    found = {(r["series_id"], r["t"]): r["mean"] for r in online.summaries().collect()}
    keys = {k for f in files for k in f}
    assert found.keys() == keys and online.summaries().count() == len(keys)
    seen = spark.createDataFrame([(i, t, y(i, t)) for i, t in sorted(keys)], "series_id long, t int, y double")
    wanted = {(r["series_id"], r["t"]): r["mean"] for r in run_filter(seen, config=CONFIG).collect()}
    assert all(abs(found[k] - wanted[k]) < 1e-9 for k in keys)
    online._batch(seen, 3)
    assert online.summaries().count() == len(keys)


@pytest.mark.parametrize("noise,grid", [("keyed", None), ("scripted", 1e6)])
@pytest.mark.parametrize("model,filter_,change", [("benchmark", "bootstrap", {}), ("growth", "auxiliary", {}), ("growth", "bootstrap", {"resampler": "stratified", "ess_share": None, "weight_on": "pre"}), ("benchmark", "bootstrap", {"n_out": 25, "accumulate": False})])
def test_folded_sets_are_the_sets_row_by_row(spark, model, filter_, change, noise, grid):
    """Series of other lengths, a gap, a null and a repeated step; folds of three steps a job."""
    rows = [(i, t, None if (i, t) == (0, 3) else 0.5 * i + t) for i, n in ((0, 7), (1, 5), (2, 1)) for t in range(1, n + 1) if (i, t) != (1, 2)] + [(0, 4, 99.0)]
    seen = spark.createDataFrame(rows, "series_id long, t int, y double")
    runs = []
    for extra in ({"packed": 0}, {"steps_at_once": 3}):
        config = FilterConfig(particles=30, seed=4, noise=noise, grid=grid, **change, **extra)
        runs.append({(r["series_id"], r["t"]): r for r in run_filter(seen, model, filter_, config).collect()})
    assert runs[0].keys() == runs[1].keys() == {(i, t) for i, n in ((0, 7), (1, 5), (2, 1)) for t in range(1, n + 1)}
    for k, r in runs[0].items():
        assert all(runs[1][k][c] == pytest.approx(r[c], rel=1e-9) for c in ("mean", "ess", "q05", "q95")), k


@pytest.mark.parametrize("theta", [None, (0.1, 0.2, 0.4, 0.1, 0.5, 0.0, -1.0, -2.0, 1.0)], ids=["unknown", "known"])
def test_hybrid_sets_under_the_bootstrap_filter(spark, theta):
    """Modes with known and with unknown parameters, as matrix rows and row by row, with a gap and a null."""
    rows = [(i, t, None if (i, t) == (0, 2) else 0.1 * i - 0.2 * t) for i, n in ((0, 3), (1, 3)) for t in range(1, n + 1) if (i, t) != (1, 2)]
    seen = spark.createDataFrame(rows, "series_id long, t int, y double")
    model = "rsgarch" if theta is None else RsGarch(theta)
    runs = [{(r["series_id"], r["t"]): r for r in run_filter(seen, model, "bootstrap", FilterConfig(particles=31, seed=4, ess_share=0.9, **extra)).collect()} for extra in ({"packed": 0}, {"steps_at_once": 2})]
    assert runs[0].keys() == runs[1].keys() and len(runs[0]) == 6
    for k, r in runs[0].items():
        assert all(runs[1][k][c] == pytest.approx(r[c], rel=1e-6, abs=1e-9) for c in r.asDict()), k
        assert 0 <= r["prob_mode0"] <= 1 and 1 <= r["ess"] <= 31 + 1e-6
        assert theta is None or [r[f"p{k}"] for k in range(9)] == pytest.approx(theta)
    with pytest.raises(ValueError):
        run_filter(seen, "rsgarch", "auxiliary")
    with pytest.raises(ValueError):
        run_filter(seen, "benchmark", "imm")
    assert run_filter(seen.where("false"), "rsgarch", "imm").count() == run_filter(seen.where("false"), "rsgarch", "bootstrap").count() == 0


def test_folded_imm_is_imm_row_by_row(spark):
    rows = [(i, t, None if (i, t) == (0, 2) else 0.1 * i - 0.2 * t) for i, n in ((0, 4), (1, 3)) for t in range(1, n + 1)]
    seen = spark.createDataFrame(rows, "series_id long, t int, y double")
    runs = [{(r["series_id"], r["t"]): r for r in run_filter(seen, "rsgarch", "imm", FilterConfig(particles=31, seed=4, **extra)).collect()} for extra in ({"packed": 0}, {"steps_at_once": 3})]
    assert runs[0].keys() == runs[1].keys() and len(runs[0]) == 7
    for k, r in runs[0].items():
        assert all(runs[1][k][c] == pytest.approx(r[c], rel=1e-6, abs=1e-9) for c in r.asDict()), k


@pytest.mark.parametrize("resampler", ["systematic", "stratified", "multinomial", "residual"])
@pytest.mark.parametrize("filter_", ["bootstrap", "auxiliary", "imm"])
def test_every_resampler_in_every_filter(spark, resampler, filter_):
    seen = spark.createDataFrame([(i, t, 0.3 * i + t) for i in range(2) for t in (1, 2)], "series_id long, t int, y double")
    out = run_filter(seen, "rsgarch" if filter_ == "imm" else "growth", filter_, FilterConfig(particles=20, seed=1, resampler=resampler, ess_share=None)).collect()
    assert sorted((r["series_id"], r["t"]) for r in out) == [(0, 1), (0, 2), (1, 1), (1, 2)]
    assert all(1 <= r["ess"] <= 20 + 1e-6 for r in out)


def test_imm_on_a_grid_is_imm_row_by_row(spark):
    """Scripted prior, parameters and modes, a step with and one without an observation."""
    seen = spark.createDataFrame([(7, 1, 0.4), (7, 2, None), (7, 3, -0.3)], "series_id long, t int, y double")
    config = FilterConfig(particles=21, seed=4, noise="scripted", grid=float(1 << 20))
    runs = [{r["t"]: r for r in run_imm(seen, replace(config, **extra)).collect()} for extra in ({"packed": 0}, {})]
    assert runs[0].keys() == runs[1].keys() == {1, 2, 3}
    for t, r in runs[0].items():
        assert all(runs[1][t][c] == pytest.approx(r[c], rel=1e-9, abs=1e-9) for c in r.asDict()), t


def test_negative_volatility_counts_as_zero():
    p = lambda k: np.array([1.5, 0.0, 0.0, 0.0, -5.0, 0, 0, 0, 0])[k : k + 1]
    r, vol = RsGarch().propagate(np.array([1.5]), np.array([2.0]), np.array([0]), p, np.array([3.0]))
    assert vol.tolist() == [0.0] and r.tolist() == [1.5]
