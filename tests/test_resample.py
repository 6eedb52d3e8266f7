"""Closed forms against textbook loops, invariants and degenerate sets."""

import random

import pytest
from pyspark.sql import functions as F

from murmuration.functions import rng
from murmuration.operators import schemes
from murmuration.operators.resample import ONE, copied, cumulated, fixed_from_log, multinomial, ranked, replicated, resample, residual, stratified, systematic


def frame(spark, weights, parts=1):
    return spark.createDataFrame([(i, i % parts, int(w), float(i)) for i, w in enumerate(weights)], "id long, part int, w long, x double")


def counts(df, key="id"):
    return {r[key]: r["cnt"] for r in df.select(key, "cnt").collect()}


def loop_systematic(weights, n, u):
    total, edges, out, k, run = sum(weights), [], [0] * len(weights), 0, 0
    for w in weights:
        run += w
        edges.append(run)
    for i in range(n):
        while (u + i) * total / n >= edges[k]:
            k += 1
        out[k] += 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_systematic_is_the_loop(spark, seed):
    r = random.Random(seed)
    weights = [r.randrange(0, 1000) for _ in range(r.randrange(2, 60))] + [7]
    n, u = r.randrange(1, 90), r.uniform(0.01, 0.99)
    found = counts(systematic(frame(spark, weights), n, u, block=r.choice([4, 1 << 16, None])))
    assert [found[i] for i in range(len(weights))] == loop_systematic(weights, n, u)


@pytest.mark.parametrize("u", [1e-12, 0.5, 1 - 1e-12])
def test_equal_weights_give_n_points_at_the_edges(spark, u):
    out = systematic(frame(spark, [ONE] * 100), 100, u)
    assert sum(counts(out).values()) == 100
    ids = [r["id"] for r in replicated(out).collect()]
    assert sorted(ids) == list(range(100))


def test_stratified_is_the_loop(spark):
    r = random.Random(3)
    weights, n = [r.randrange(0, 50) for _ in range(40)], 33
    found = counts(stratified(frame(spark, weights), n, lambda i: rng.lcg(i), block=8))
    total, run, edges = sum(weights), 0, []
    for w in weights:
        run += w
        edges.append(run)
    wanted = [0] * len(weights)
    for i in range(n):
        u = ((i * 1103515245 + 12345) % 2147483648) / 2147483648
        wanted[next(k for k, e in enumerate(edges) if (i + u) < n * e / total)] += 1
    assert [found[i] for i in range(len(weights))] == wanted


def test_multinomial_and_residual(spark):
    weights = [5, 0, 1, 90, 4]
    draws = spark.range(500).select(rng.uniform("id", seed=1).alias("u"))
    for buckets in (1, 7, 600):
        found = counts(multinomial(frame(spark, weights), draws, buckets))
        assert sum(found.values()) == 500 and found[1] == 0
        first = found if buckets == 1 else first
        assert found == first  # buckets only deal the work
    found = counts(residual(frame(spark, weights), 50, lambda i: rng.uniform(i, seed=2), 8))
    assert sum(found.values()) == 50
    for i, w in enumerate(weights):
        assert found[i] >= 50 * w // 100
    again = counts(ranked(frame(spark, weights).join(spark.createDataFrame(list(found.items()), "id long, cnt long"), "id")))
    assert sum(again.values()) == 50


def test_result_does_not_depend_on_partitions(spark):
    weights = [random.Random(1).randrange(1, 10**9) for _ in range(500)]
    one = counts(systematic(frame(spark, weights).coalesce(1), 300, 0.3, block=64))
    many = counts(systematic(frame(spark, weights).repartition(9), 300, 0.3, block=16))
    assert one == many


def test_degenerate_sets(spark):
    assert sum(counts(systematic(frame(spark, [0, 0, 0]), 5, 0.5)).values()) == 0
    assert counts(systematic(frame(spark, [9]), 5, 0.5)) == {0: 5}
    assert counts(systematic(frame(spark, [1, 10**15, 1]), 4, 0.5)) == {0: 0, 1: 4, 2: 0}
    assert systematic(frame(spark, [1]).where("false"), 5, 0.5).count() == 0
    assert residual(frame(spark, [0, 0]), 5, lambda i: rng.uniform(i), 4).agg(F.sum("cnt")).first()[0] == 0


def test_log_weights_that_vanish(spark):
    rows = spark.createDataFrame([(0, -1e9), (1, -1e9 - 1), (2, float("-inf")), (3, float("nan")), (4, None)], "id long, lw double")
    found = {r["id"]: r["w"] for r in fixed_from_log(rows, "lw").collect()}
    assert found[0] == ONE and 0 < found[1] < ONE and found[2] == found[3] == found[4] == 0
    gone = fixed_from_log(rows.where("id >= 2"), "lw")
    assert {r["w"] for r in gone.collect()} == {ONE}
    with pytest.raises(Exception, match="zero"):
        fixed_from_log(rows.where("id >= 2"), "lw", policy="raise").collect()


@pytest.mark.parametrize("how", ["systematic", "stratified", "multinomial", "residual"])
def test_resamplers_by_name_are_unbiased(spark, how):
    weights, n = [10, 20, 30, 40], 40
    total = [0] * 4
    for seed in range(5):
        found = counts(resample(frame(spark, weights), how, n, seed, 4))
        assert sum(found.values()) == n
        total = [a + found.get(i, 0) for i, a in enumerate(total)]
    for w, got in zip(weights, total, strict=True):
        assert abs(got / 5 - n * w / 100) < 6


def test_cumulated_in_blocks(spark):
    rows = cumulated(frame(spark, range(1, 40), parts=3), keys=["part"], block=5).collect()
    for part in range(3):
        run = 0
        for r in sorted((r for r in rows if r["part"] == part), key=lambda r: r["id"]):
            run += r["w"]
            assert r["cw"] == run
        assert all(r["tw"] == run for r in rows if r["part"] == part)


def keyed(*keys):
    return rng.uniform(*keys, seed=4)


@pytest.mark.parametrize("name", sorted(schemes.SCHEMES))
@pytest.mark.parametrize("n,parts", [(30, 4), (31, 4), (3, 4)])
def test_schemes_keep_their_promises(spark, name, n, parts):
    df = frame(spark, [i % 7 + 1 for i in range(30)], parts)
    out = schemes.SCHEMES[name](df, n, parts, keyed, keyed).collect()
    ids = [(r["part"], r["id"]) for r in out]
    assert len(set(ids)) == len(ids)
    if name in ("cen", "dist1", "dist2", "hiera"):
        assert len(out) == n
    if name == "decen":
        assert len(out) == 30
    if name in ("cen", "dist2", "hiera", "dist1", "decen"):
        assert abs(sum(r["weight"] for r in out) - 1) < 1e-9


def test_equal_part_sums_are_no_special_case(spark):
    df = frame(spark, [5] * 20, 4)
    out = schemes.hierarchical(df, 20, keyed, keyed)
    assert out.count() == 20


def test_copies_for_counts(spark):
    df = frame(spark, [1, 1, 1]).withColumn("cnt", F.col("id"))
    assert copied(df).count() == 3


@pytest.mark.parametrize("counts", [[3, 0, 1, 0, 2, 0], [0, 0, 0, 6, 0, 0], [1, 1, 1, 1, 1, 1], [0, 4, 0, 0, 0, 5], [0, 0, 2, 0, 0, 0]])
def test_survivors_keep_their_slots(spark, counts):
    """The plain loop: every free slot takes the first row that still has a copy to spare."""
    from murmuration.operators.resample import kept_in_place

    rows = [(k, i, float(10 * k + i), c) for k in (0, 1) for i, c in enumerate(counts)]
    df = spark.createDataFrame(rows, "k int, id long, x double, cnt long")
    left, wanted = [max(0, c - 1) for c in counts], {i: i for i, c in enumerate(counts) if c}
    spare = iter([j for j, c in enumerate(left) for _ in range(c)])
    for i in [i for i, c in enumerate(counts) if c == 0]:
        if (j := next(spare, None)) is not None:
            wanted[i] = j
    for i, j in enumerate(spare, len(counts)):
        wanted[i] = j
    for keys, block in (["k"], 1 << 16), (["k"], 2):
        found = {(r["k"], r["id"]): (r["source"], r["x"]) for r in kept_in_place(df, keys, block=block).collect()}
        assert found == {(k, i): (j, float(10 * k + j)) for k in (0, 1) for i, j in wanted.items()}
    alone = {r["id"]: r["source"] for r in kept_in_place(df.where("k = 0").drop("k")).collect()}
    assert alone == wanted
    assert kept_in_place(df.where("false"), ["k"]).count() == 0
