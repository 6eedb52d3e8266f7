"""Selection and exchange at size: draws are dealt over tasks and never broadcast, repeated selections keep sums only."""

import pytest
from pyspark.sql import functions as F

from murmuration.functions.rng import lcg
from murmuration.operators import schemes
from murmuration.operators.resample import replicated, systematic
from murmuration.plans import registry

from .conftest import SMALL

PARTS = 4


def frame(spark, n):
    return spark.range(n).selectExpr("id * 3 as id", "cast(id % 4 as int) as part", "(id * 7919) % 101 + 1 as w", "cast(id as double) / 7 as x")


def index(part, target, j):
    return lcg(part.cast("long") * 1000003 + target * 10007 + j * 31)


def joins(df):
    """The joins of the plan that was run in the end."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


@pytest.mark.parametrize("scheme", ["selected", "dpf", "sub"])
def test_draws_are_not_broadcast(spark, scheme):
    """The planner takes all draws for the few rows that they come from."""
    made = {
        "selected": lambda df: schemes.selected(df, PARTS, index),
        "dpf": lambda df: schemes.dpf(df, 20, PARTS, lambda part: F.lit(0.5), index),
        "sub": lambda df: schemes.subset(df, 20, PARTS, lambda part: F.lit(0.5), index),
    }[scheme]
    assert "SortMergeJoin [__at" in joins(made(frame(spark, 400)))


def test_stretches_of_draws_make_no_difference(spark, monkeypatch):
    df = frame(spark, 203)
    wanted = {(r["part"], r["id"], r["w"], r["x"]) for r in schemes.selected(df, PARTS, index, extra=1).collect()}
    assert len(wanted) == sum(PARTS * (n // PARTS + 1) for n in (51, 51, 51, 50))
    monkeypatch.setattr(schemes, "DRAWS", 5)
    assert {(r["part"], r["id"], r["w"], r["x"]) for r in schemes.selected(df, PARTS, index, extra=1).collect()} == wanted


@pytest.mark.parametrize("n", [2000, 10, 3])
def test_repeated_selections_are_single_ones(spark, monkeypatch, n):
    """Stretches of one id and of many; no selection is kept as rows."""
    df, sims = frame(spark, 1500), 3
    u = lambda sim, part: lcg(sim * 13 + part) * 0.98 + 0.01
    of_sim = lambda sim: lambda part, target, j: lcg(F.lit(sim).cast("long") * 5000011 + part * 1000003 + target * 10007 + j * 31)
    kept, cut = [], schemes.cut
    monkeypatch.setattr(schemes, "cut", lambda rows: kept.append(cut(rows)) or kept[-1])
    found = {(r["sim"], r["part"]): r for r in schemes.repeated_selection(df, n, PARTS, sims, u, lambda sim, *at: lcg(sim.cast("long") * 5000011 + at[0] * 1000003 + at[1] * 10007 + at[2] * 31)).collect()}
    assert len(found) == sims * PARTS
    for sim in range(sims):
        chosen = schemes.selected(df, PARTS, of_sim(sim)).cache()
        rows = chosen.collect()
        points = replicated(systematic(chosen, schemes.share_of(n, PARTS, F.col("part")), u(F.lit(sim), F.col("part")), keys=["part"])).groupBy("part").agg(F.avg("x").alias("m"))
        means = {r["part"]: r["m"] for r in points.collect()}
        for part in range(PARTS):
            own = [r for r in rows if r["part"] == part]
            r, w = found[sim, part], sum(r["w"] for r in own)
            assert r["weight"] == pytest.approx(w / sum(r["w"] for r in rows)) and r["mean"] == pytest.approx(sum(r["w"] * r["x"] for r in own) / w)
            assert r["resampled"] == (pytest.approx(means[part]) if part in means else None)
    if n < 100:
        assert max(k.count() for k in kept[1:]) < sims * 1500 / 4


@pytest.mark.parametrize("name", ["dpf_step", "scheme_comparison", "sub_step"])
def test_queries_do_not_broadcast_draws(spark, name):
    plan = joins(registry.queries()[name](spark, SMALL))
    assert "SortMergeJoin [__at" in plan and "BroadcastHashJoin [__at" not in plan
