"""Partitioned runs over the bound of a task go in chunks of particles, all runs in the same jobs."""

from dataclasses import replace
from pathlib import Path

import pytest

from murmuration.operators import chunked_schemes, filters
from murmuration.operators.filters import run_scheme, run_schemes
from murmuration.operators.models import BenchmarkModel
from murmuration.plans.running import MR_SCHEMES, MR_SIDE, SPARK_SCHEMES, SPARK_SIDE


@pytest.fixture(scope="module")
def inputs(spark):
    particles = spark.range(101).selectExpr("id * 1000003 as id", "cast(id * id % 4 as int) as part", "cast(id as double) / 10 - 5 as x")
    return particles, spark.createDataFrame([(1, 1.0), (2, 3.0), (4, 0.5), (5, 25.0), (6, 2.0)], "t int, y double")


@pytest.mark.parametrize("side,change", [(SPARK_SIDE, {}), (MR_SIDE, {"noise": "keyed", "grid": None, "n_out": 90})], ids=["spark", "mapreduce"])
def test_chunks_are_the_whole_set(spark, inputs, monkeypatch, tmp_path, side, change):
    """Chunks of 7 particles, sparse ids, sub-filters of other sizes, an observation far out; two steps are kept, not all."""
    names = SPARK_SCHEMES + MR_SCHEMES
    told = lambda config: {(r["scheme"], r["t"]): r for r in run_schemes(*inputs, names, BenchmarkModel(), config).collect()}
    wanted = told(replace(side, **change))

    def none(*args, **more):
        raise AssertionError("a job for each step and run")

    monkeypatch.setattr(filters, "run_scheme", none)
    monkeypatch.setattr(chunked_schemes, "new_path", lambda spark, name: str(tmp_path / name))
    found = told(replace(side, **change, packed_run=0, block=7))
    assert found.keys() == wanted.keys() == {(s, t) for s in names for t in (1, 2, 4, 5, 6)}
    for k, r in wanted.items():
        assert all(found[k][c] == pytest.approx(r[c], rel=1e-9) for c in ("mean", "ess")), k
    assert sorted(p.name for p in Path(tmp_path, "chunks").iterdir()) == ["0", "1", "selected"]


@pytest.mark.parametrize("scheme", ["dpf", "dist3"])
def test_runs_row_by_row_are_the_same(inputs, scheme):
    wanted = {r["t"]: r for r in run_scheme(*inputs, scheme, BenchmarkModel(), SPARK_SIDE)[1].collect()}
    found = {r["t"]: r for r in run_schemes(*inputs, (scheme,), BenchmarkModel(), replace(SPARK_SIDE, packed_run=0)).collect()}
    assert found.keys() == wanted.keys()
    assert all(found[t][c] == pytest.approx(r[c], rel=1e-9) for t, r in wanted.items() for c in ("mean", "ess"))


def test_tasks_follow_the_chunks(spark):
    """A larger set takes more tasks, not more chunks a task."""
    few = spark.sparkContext.defaultParallelism
    assert chunked_schemes._tasks(spark, 1) == few
    assert chunked_schemes._tasks(spark, 10_000) == 10_000 // chunked_schemes.TASK
