"""Stored sets of earlier steps: both ways of running leave the same, and a step is read alone."""

import pytest
from pyspark.sql import functions as F

from murmuration.operators.filters import FilterConfig, history_of, run_filter
from murmuration.operators.history import History, weights_of
from murmuration.operators.resample import ONE


@pytest.fixture(scope="module")
def seen(spark):
    rows = [(i, t, None if (i, t) == (0, 3) else 0.5 * i + t) for i, n in ((0, 4), (1, 3), (2, 1)) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "series_id long, t int, y double")


@pytest.fixture(scope="module", params=[("benchmark", "bootstrap"), ("growth", "auxiliary")], ids=["bootstrap", "auxiliary"])
def both(spark, seen, request, tmp_path_factory):
    """The histories of a run of matrix rows, in jobs of three steps, and of one row by row."""
    out = []
    for extra in ({"steps_at_once": 3}, {"packed": 0}):
        path = str(tmp_path_factory.mktemp("history") / "sets")
        run_filter(seen, *request.param, FilterConfig(particles=20, seed=6, **extra), store=path)
        out.append(history_of(seen, path))
    return out


def test_both_ways_store_the_same(both):
    rows = [{(r["series_id"], r["t"], r["id"]): r for r in h.steps().collect()} for h in both]
    assert rows[0].keys() == rows[1].keys() == {(i, t, k) for i, n in ((0, 4), (1, 3), (2, 1)) for t in range(1, n + 1) for k in range(20)}
    for key, r in rows[0].items():
        assert (r["parent"], r["w"]) == (rows[1][key]["parent"], pytest.approx(rows[1][key]["w"], abs=4)) and r["x"] == pytest.approx(rows[1][key]["x"]), key


def test_statistics_of_a_step(spark, seen, both):
    for h in both:
        steps = {}
        for r in h.steps().collect():
            steps.setdefault((r["series_id"], r["t"]), []).append(r)
        ess = {r["series_id"]: r["ess"] for r in h.effective_size(3).collect()}
        square = {r["series_id"]: r["value"] for r in h.integral(F.col("x") * F.col("x"), 3).collect()}
        assert ess.keys() == square.keys() == {0, 1}
        for i in ess:
            own = steps[i, 3]
            total = sum(r["w"] for r in own)
            assert ess[i] == pytest.approx(total**2 / sum(r["w"] ** 2 for r in own))
            assert square[i] == pytest.approx(sum(r["w"] * r["x"] ** 2 for r in own) / total)
        assert h.effective_size(9).count() == 0


def test_ancestors_follow_parents(both):
    for h in both:
        steps = {(r["series_id"], r["t"], r["id"]): r for r in h.steps().collect()}
        found = h.ancestors(4, 1).collect()
        assert len(found) == 20 * 4  # only series 0 has a fourth step
        for r in found:
            at, t = r["id"], 4
            while t > r["t"]:
                at, t = steps[r["series_id"], t, at]["parent"], t - 1
            assert r["ancestor"] == at and r["x"] == steps[r["series_id"], t, at]["x"]


def test_a_step_is_read_alone(both):
    plan = both[0].effective_size(2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(t" in plan


def test_log_weights(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0, 0, -1.0, 1.0), (1, 0, 0, None, 2.0)], "id long, parent long, part int, lw double, x double")
    h = History(spark, str(tmp_path / "sets"), "id long, parent long, part int, lw double, x double", ())
    h.write(rows, 1)
    h.write(rows, 1)  # a step that is written again
    assert {r["id"]: r["w"] for r in h.weighted(1).collect()} == {0: ONE, 1: 0}
    assert {r["w"] for r in weights_of(rows.where("lw is null"), []).collect()} == {ONE}
