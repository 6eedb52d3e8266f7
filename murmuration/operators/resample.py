"""Prefix sums and the four resamplers.

Weights are fixed-point longs. Their sums are exact in any order, so cumulated
weights do not depend on partitions, a row's lower bound is exactly the upper
bound of the row before, and no second pass over neighbours is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform

#: Fixed-point units of a weight of 1; 2**31 particles still sum in a long.
ONE = 1 << 32
BLOCK = 1 << 16


def fixed(w: Column, one: int = ONE) -> Column:
    """A weight in [0, 1] as a long."""
    return F.round(w * F.lit(float(one))).cast("long")


def clean(log_w: Column) -> Column:
    """A log-weight, null where it is no number."""
    return F.when(F.isnan(log_w) | (log_w == float("-inf")), None).otherwise(log_w)


def log_of(w: Column) -> Column:
    """The logarithm of a fixed-point weight."""
    return F.when(w > 0, F.log(w / F.lit(float(ONE)))).otherwise(F.lit(float("-inf")))


def on_grid(x: Column, grid: float | None) -> Column:
    """x on a grid of 1/grid, so that engines whose last bits differ keep the same state."""
    return x if grid is None else F.floor(x * F.lit(grid) + 0.5) / F.lit(grid)


def fixed_from_log(df: DataFrame, log_w: str, keys: Sequence[str] = (), out: str = "w", policy: str = "uniform") -> DataFrame:
    """Weights from log-weights, shifted by the largest of each key.

    Where all weights of a key vanish (only -inf, null or NaN), they become
    equal under ``policy="uniform"`` or the job fails under ``"raise"``.
    """
    lw = F.when(F.isnan(log_w), None).otherwise(F.col(log_w))
    lw = F.when(lw == float("-inf"), None).otherwise(lw)
    top = df.groupBy(*keys).agg(F.max(lw).alias("__top"))
    joined = df.join(top, list(keys)) if keys else df.crossJoin(F.broadcast(top))  # one row
    none = F.lit(ONE) if policy == "uniform" else F.raise_error(F.lit("all weights are zero")).cast("long")
    weight = F.when(F.col("__top").isNull(), none).otherwise(F.coalesce(fixed(F.exp(lw - F.col("__top"))), F.lit(0).cast("long")))
    return joined.withColumn(out, weight).drop("__top")


def cumulated(df: DataFrame, w: str = "w", keys: Sequence[str] = (), order: str = "id", block: int | None = BLOCK) -> DataFrame:
    """``df`` with ``cw`` (running sum in ``order``, inclusive) and ``tw`` (total), both exact.

    In two levels: windows over blocks of ``block`` consecutive values of
    ``order``, then a running sum over one row per block. No task orders a
    whole set. ``block=None`` is for sets whose keys are small by themselves.
    """
    keys = list(keys)
    if block is None:
        whole = Window.partitionBy(*keys)
        return df.withColumn("cw", F.sum(w).over(whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))).withColumn("tw", F.sum(w).over(whole))
    blocked = df.withColumn("__b", F.floor(F.col(order) / block))
    inside = Window.partitionBy(*keys, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = blocked.groupBy(*keys, "__b").agg(F.sum(w).alias("__s"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    running = over.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    bases = sums.select(*keys, "__b", (F.sum("__s").over(running) - F.col("__s")).alias("__base"), F.sum("__s").over(over).alias("tw"))
    local = blocked.withColumn("__local", F.sum(w).over(inside))
    return local.join(bases, [*keys, "__b"]).withColumn("cw", F.col("__base") + F.col("__local")).drop("__b", "__base", "__local")


def _n(n) -> Column:
    return F.lit(n).cast("long") if isinstance(n, int) else n


def systematic_bound(n: Column, u: Column) -> Callable[[Column, Column], Column]:
    """How many of the points (u + i) / n lie under the running weight ``c`` of a total ``tw``."""

    def bound(c, tw):
        at = F.ceil(n.cast("double") * c / F.nullif(tw, F.lit(0)) - u)
        return F.coalesce(F.least(n, F.greatest(F.lit(0).cast("long"), at)), F.lit(0).cast("long"))

    return bound


def stratified_bound(n: Column, draw: Callable[[Column], Column]) -> Callable[[Column, Column], Column]:
    """The same with a point ``draw(i)`` in each of n equal strata."""

    def bound(c, tw):
        at = n.cast("double") * c / F.nullif(tw, F.lit(0))
        whole = F.floor(at)
        return F.coalesce(F.least(n, whole + F.when(at - whole > draw(whole), 1).otherwise(0)), F.lit(0).cast("long"))

    return bound


def _bounded(df: DataFrame, bound, w: str, keys: Sequence[str], order: str, block: int | None) -> DataFrame:
    c = cumulated(df, w, keys, order, block)
    out = c.withColumn("lo", bound(F.col("cw") - F.col(w), F.col("tw"))).withColumn("hi", bound(F.col("cw"), F.col("tw")))
    return out.withColumn("cnt", F.col("hi") - F.col("lo")).drop("cw", "tw")


def systematic(df: DataFrame, n, u, w: str = "w", keys: Sequence[str] = (), order: str = "id", block: int | None = BLOCK) -> DataFrame:
    """``df`` with ``lo, hi, cnt``: the points (u + i) / n that fall in each row's stretch of the weights.

    ``u`` is in (0, 1), so the first row begins at 0 and the last ends at n.
    A zero total gives no points.
    """
    return _bounded(df, systematic_bound(_n(n), u if isinstance(u, Column) else F.lit(float(u))), w, keys, order, block)


def stratified(df: DataFrame, n, draw, w: str = "w", keys: Sequence[str] = (), order: str = "id", block: int | None = BLOCK) -> DataFrame:
    """``lo, hi, cnt`` with one uniform ``draw(i)`` in each of n equal strata, in closed form."""
    return _bounded(df, stratified_bound(_n(n), draw), w, keys, order, block)


def multinomial(df: DataFrame, draws: DataFrame, buckets: int | Column, w: str = "w", keys: Sequence[str] = (), order: str = "id", block: int | None = BLOCK) -> DataFrame:
    """``df`` with ``cnt``: how many of ``draws(keys, u)``, u in [0, 1), fall on each row.

    Both sides are dealt into ``buckets`` equal stretches of the total weight
    and joined on the bucket, so neither is sorted as a whole. About as many
    buckets as rows keep both sides of a bucket small; their number may differ
    by key, as a Column of the keys.
    """
    keys = list(keys)
    c = cumulated(df, w, keys, order, block).where(F.col(w) > 0)
    buckets = _n(buckets)
    scale = buckets.cast("double")
    low = F.least(F.floor((F.col("cw") - F.col(w)) / F.col("tw") * scale), buckets - 1)
    high = F.least(F.floor(F.col("cw") / F.col("tw") * scale), buckets - 1)
    spread = c.select(*keys, F.col(order).alias("__id"), (F.col("cw") - F.col(w)).alias("__lo"), F.col("cw").alias("__hi"), "tw", F.explode(F.sequence(low, high)).alias("__k"))
    dealt = draws.select(*keys, "u", F.least(F.floor(F.col("u") * scale), buckets - 1).alias("__k"))
    at = F.floor(F.col("u") * F.col("tw"))
    hits = dealt.join(spread, [*keys, "__k"]).where((at >= F.col("__lo")) & (at < F.col("__hi")))
    counts = hits.groupBy(*keys, F.col("__id").alias(order)).agg(F.count("*").alias("cnt"))
    return df.join(counts, [*keys, order], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0).cast("long")))


def residual(df: DataFrame, n, draw, buckets: int | Column, w: str = "w", keys: Sequence[str] = (), order: str = "id", block: int | None = BLOCK) -> DataFrame:
    """``df`` with ``cnt``: the whole part of n * w / total, and the rest drawn by what is left over.

    ``draw(i)`` is the i-th uniform of a key; how many are needed is a table of
    one row a key. A zero total gives no rows.
    """
    keys, n = list(keys), _n(n)
    totals = df.groupBy(*keys).agg(F.sum(w).alias("__tw"))
    joined = df.join(totals, keys) if keys else df.crossJoin(F.broadcast(totals))  # one row
    share, tw = n * F.col(w), F.nullif("__tw", F.lit(0))
    split = joined.withColumn("__whole", F.coalesce(F.floor((share - share % tw) / tw), F.lit(0)).cast("long"))
    split = split.withColumn("__rest", F.coalesce(F.floor((share % tw) / tw.cast("double") * F.lit(float(ONE))), F.lit(0)).cast("long")).drop("__tw")
    missing = split.groupBy(*keys).agg((F.max(n) - F.sum("__whole")).alias("__missing"), F.sum("__rest").alias("__left")).where("__missing > 0 and __left > 0")
    draws = missing.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("__missing") - 1)).alias("__i")).select(*keys, draw(F.col("__i")).alias("u"))
    drawn = multinomial(split, draws, buckets, "__rest", keys, order, block)
    return drawn.withColumn("cnt", F.col("__whole") + F.col("cnt")).drop("__whole", "__rest")


def replicated(df: DataFrame, out: str = "id") -> DataFrame:
    """One row for each of a row's points lo..hi-1; the point is the new id, unique in its key."""
    return df.where("hi > lo").withColumn(out, F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).drop("lo", "hi", "cnt")


def kept_in_place(df: DataFrame, keys: Sequence[str] = (), order: str = "id", block: int | None = BLOCK) -> DataFrame:
    """The resampled set of ``df`` with ``cnt``, survivors in their own slots; ``source`` is where a row's state comes from.

    A row that is chosen keeps its ``order`` and its state, so it need not be
    written again. Its further copies go to the slots of rows that are not:
    copies and free slots are numbered by exact prefix sums, both in order, and
    meet by their numbers. With fewer points than rows some slots stay out;
    copies beyond the free slots go after the last one, in the same order.
    """
    keys = list(keys)
    extra = F.greatest(F.col("cnt") - 1, F.lit(0)).cast("long")
    stay = df.where("cnt > 0").withColumn("source", F.col(order)).drop("cnt")
    free = cumulated(df.select(*keys, order, (F.col("cnt") == 0).cast("long").alias("__one")), "__one", keys, order, block)
    slots = free.where("__one = 1").select(*keys, (F.col("cw") - 1).alias("__rank"), F.col(order).alias("__slot"))
    ends = free.groupBy(*keys).agg(F.max(order).alias("__last"), F.max("tw").alias("__free"))
    surplus = cumulated(df.withColumn("__extra", extra), "__extra", keys, order, block).where("__extra > 0")
    copies = surplus.withColumn("__rank", F.explode(F.sequence(F.col("cw") - F.col("__extra"), F.col("cw") - 1))).drop("cw", "tw", "__extra", "cnt")
    placed = copies.join(slots, [*keys, "__rank"], "left")
    placed = placed.join(ends, keys) if keys else placed.crossJoin(F.broadcast(ends))  # one row
    slot = F.coalesce("__slot", F.col("__last") + 1 + F.col("__rank") - F.col("__free"))
    moved = placed.withColumn("source", F.col(order)).withColumn(order, slot).drop("__rank", "__slot", "__last", "__free")
    return stay.unionByName(moved)


def copied(df: DataFrame, order: str = "id") -> DataFrame:
    """One row for each count, for resamplers without positions; ids are (old id, copy) hashed apart by rank."""
    many = df.where("cnt > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cnt") - 1)))
    return many.drop("cnt")


def ranked(df: DataFrame, keys: Sequence[str] = (), order: str = "id", block: int | None = BLOCK) -> DataFrame:
    """Counts as positions: ``lo, hi`` from a prefix sum over ``cnt``."""
    c = cumulated(df, "cnt", keys, order, block)
    return c.withColumn("lo", F.col("cw") - F.col("cnt")).withColumn("hi", F.col("cw")).drop("cw", "tw")


def _draws(df: DataFrame, n, keys: Sequence[str], draw) -> DataFrame:
    """``keys, u``: n uniforms for each key. ``n`` may be a Column of the keys."""
    each = df.select(*keys).distinct() if keys else df.sparkSession.range(1).select()
    return each.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), _n(n) - 1)).alias("__i")).select(*keys, draw(F.col("__i")).alias("u"))


def _systematic(df, n, draw, keys=(), block=BLOCK):
    return systematic(df, n, draw(None), keys=keys, block=block)


def _stratified(df, n, draw, keys=(), block=BLOCK):
    return stratified(df, n, draw, keys=keys, block=block)


def _multinomial(df, n, draw, keys=(), block=BLOCK):
    return ranked(multinomial(df, _draws(df, n, keys, draw), n, keys=keys, block=block), keys, block=block)


def _residual(df, n, draw, keys=(), block=BLOCK):
    return ranked(residual(df, n, draw, n, keys=keys, block=block), keys, block=block)


#: Resamplers by name; each takes (df, n, draw, keys, block) and gives lo, hi, cnt. ``draw(i)`` is a key's i-th uniform, ``draw(None)`` its only one.
RESAMPLERS = {"systematic": _systematic, "stratified": _stratified, "multinomial": _multinomial, "residual": _residual}


def resample(df: DataFrame, how: str, n: int, seed: int, rows: int | None = None) -> DataFrame:
    """``lo, hi, cnt`` by the named resampler over the whole set."""
    if how not in RESAMPLERS:
        raise ValueError(f"no resampler is called {how}")
    return RESAMPLERS[how](df, n, lambda i: uniform(*([] if i is None else [i]), seed=seed, tag=how))
