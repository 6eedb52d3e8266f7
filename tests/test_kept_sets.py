"""Stored sets go to the store as they are made: a bounded number at a time, and to no other place."""

import pytest

from murmuration.operators import filters, packed
from murmuration.operators.filters import FilterConfig, history_of, run_filter


def test_kept_sets_are_bounded():
    for particles in (1, 64, 1024):
        for steps in (1, 16, 256):
            assert packed.block_of(particles, steps, True) * particles * steps <= packed.KEPT
            assert packed.block_of(particles, steps, False) == packed.CELLS // particles


def test_only_the_store_has_the_sets(spark, tmp_path, monkeypatch):
    """No checkpoint holds the sets of all steps, and a run of more steps than a job takes stores every one."""
    seen = spark.createDataFrame([(i, t, 0.5 * i + t) for i, n in ((0, 7), (1, 4)) for t in range(1, n + 1)], "series_id long, t int, y double")
    config, held, cut = FilterConfig(particles=20, seed=6), [], filters.cut
    wanted = {(r["series_id"], r["t"]): r["mean"] for r in run_filter(seen, config=config).collect()}
    monkeypatch.setattr(filters, "KEPT_STEPS", 3)
    monkeypatch.setattr(filters, "cut", lambda rows: held.append(rows.schema.simpleString()) or cut(rows))
    found = {(r["series_id"], r["t"]): r["mean"] for r in run_filter(seen, config=config, store=str(tmp_path / "sets")).collect()}
    assert found == pytest.approx(wanted)
    assert held and not any("q95:double,w:" in h for h in held)
    stored = history_of(seen, str(tmp_path / "sets")).steps().groupBy("series_id", "t").count().collect()
    assert {(r["series_id"], r["t"]): r["count"] for r in stored} == {(i, t): 20 for i, n in ((0, 7), (1, 4)) for t in range(1, n + 1)}
