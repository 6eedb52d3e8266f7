"""Weighted statistics of particle sets, all as plain aggregates."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resample import cumulated, systematic_bound


def _w(w) -> Column:
    return F.col(w) if isinstance(w, str) else w


def weighted_mean(x, w="w") -> Column:
    return F.sum(_w(w) * _w(x)) / F.nullif(F.sum(_w(w)), F.lit(0))


def effective_size(w="w") -> Column:
    """(sum w)^2 / sum w^2."""
    d = _w(w).cast("double")
    return F.sum(d) * F.sum(d) / F.nullif(F.sum(d * d), F.lit(0.0))


def integral(f: Callable[..., Column] | Column, w="w") -> Column:
    """Weighted mean of any expression of a row."""
    return weighted_mean(f() if callable(f) else f, w)


def mode_probability(q="q", mode: int = 0, w="w") -> Column:
    return F.sum(F.when(_w(q) == mode, _w(w)).otherwise(0)) / F.nullif(F.sum(_w(w)), F.lit(0))


def quantile_band(x, low: float = 0.05, high: float = 0.95) -> list[Column]:
    """Unweighted quantiles by linear interpolation."""
    both = F.percentile(_w(x), F.array(F.lit(low), F.lit(high)))
    return [F.get(both, 0).alias("q05"), F.get(both, 1).alias("q95")]


#: Groups up to this many rows may stand in one aggregate.
SMALL_GROUP = 10_000


def banded(df: DataFrame, x: str, keys: Sequence[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """``keys, q05, q95``: :func:`quantile_band` of each key, however many rows a key has.

    In a large group a sketch of bounded size first gives values a thousandth
    of the rows below and above each rank, five errors of the sketch away. The
    rows between them are few; the rest only counts. Ranks among those, and so
    the quantiles, are exact.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(x).alias("__x")).where("__x is not null")
    slack, shares = 0.001, (low, high)
    wanted = [float(min(1.0, max(0.0, p + d))) for p in shares for d in (-slack, slack)]
    counted = values.groupBy(*keys).agg(F.count("*").alias("__n"), F.percentile_approx("__x", F.array(*map(F.lit, wanted)), F.lit(5000)).alias("__c"))
    large = counted.where(F.col("__n") > SMALL_GROUP)
    of_small = values.join(counted.where(F.col("__n") <= SMALL_GROUP).select(*keys), keys).groupBy(*keys).agg(*quantile_band("__x", low, high))
    near = values.join(large, keys)
    sides = F.array(*[F.struct(F.lit(k).alias("__k"), F.get("__c", 2 * k).alias("__from"), F.get("__c", 2 * k + 1).alias("__to"), ((F.col("__n") - 1) * F.lit(p)).alias("__place")) for k, p in enumerate(shares)])
    each = near.select(*keys, "__x", F.inline(sides)).where(F.col("__x") <= F.col("__to"))
    counts = each.groupBy(*keys, "__k", "__from", "__place").agg(F.count_if(F.col("__x") < F.col("__from")).alias("below"))
    order = Window.partitionBy(*keys, "__k").orderBy("__x")
    ranked = each.where(F.col("__x") >= F.col("__from")).select(*keys, "__k", "__x", F.row_number().over(order).alias("rank")).join(counts, [*keys, "__k"])
    at = F.col("below") + F.col("rank") - 1
    share = F.when(at == F.floor("__place"), F.floor("__place") + 1 - F.col("__place")).when(at == F.floor("__place") + 1, F.col("__place") - F.floor("__place"))
    found = ranked.withColumn("share", share).where("share is not null").groupBy(*keys, "__k").agg(F.sum(F.col("share") * F.col("__x")).alias("q"))
    of_large = found.groupBy(*keys).agg(F.max(F.when(F.col("__k") == 0, F.col("q"))).alias("q05"), F.max(F.when(F.col("__k") == 1, F.col("q"))).alias("q95"))
    return of_small.unionByName(of_large)


#: Stretches of values that weighted quantiles are sought in.
STRETCHES = 4096


def weighted_quantiles(df: DataFrame, x: str, w: str, probs: Sequence[float]) -> DataFrame:
    """``prob, value``: the first value whose running weight reaches each share (exact for fixed-point weights).

    Approximate quantiles of the distinct values cut these into stretches of
    about equal numbers, wherever outliers lie. Stretches are weighed as a
    whole, and only the one that holds a share is ordered. Rows of null x or
    without weight do not count; NaN is the largest value; an empty table gives
    no rows.
    """
    by_value = df.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("__x")).agg(F.sum(w).alias("__w")).where(F.col("__w") > 0)
    inner = sorted(set(by_value.approxQuantile("__x", [k / STRETCHES for k in range(1, STRETCHES)], 0.5 / STRETCHES)))
    splits = [-math.inf, *(c for c in inner if math.isfinite(c)), math.inf]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    placed = Bucketizer(splits=splits, inputCol="__x", outputCol="__b", handleInvalid="keep").transform(by_value)
    # a row for each stretch
    stretches = placed.groupBy("__b").agg(F.sum("__w").alias("__w"))
    running = stretches.select("__b", F.sum("__w").over(Window.orderBy("__b")).alias("__cw"), "__w", F.sum("__w").over(Window.partitionBy()).alias("__tw"))
    wanted = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    reached = running.select("__b", (F.col("__cw") - F.col("__w")).alias("__below"), "__cw", "__tw", wanted).where(F.col("__cw") >= F.col("prob") * F.col("__tw"))
    held = reached.groupBy("prob").agg(F.min_by(F.struct("__b", "__below", "__tw"), "__b").alias("__at")).select("prob", "__at.*")
    inside = placed.join(F.broadcast(held), "__b")  # a row for each share
    order = Window.partitionBy("prob").orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.select("prob", "__x", "__tw", (F.col("__below") + F.sum("__w").over(order)).alias("__cw"))
    return ranked.where(F.col("__cw") >= F.col("prob") * F.col("__tw")).groupBy("prob").agg(F.min("__x").alias("value"))


def mean_and_variance(x, about: Column | None = None) -> list[Column]:
    """Mean, and the population variance about it or about a given mean."""
    variance = F.var_pop(_w(x)) if about is None else F.avg((_w(x) - about) * (_w(x) - about))
    return [F.avg(_w(x)).alias("mean"), variance.alias("variance")]


def histogram(df: DataFrame, x: str, w: str | None = None, bins: int = 50) -> DataFrame:
    """``bin, left, center, density``: normalised, the right edge in the last bin, empty bins left out."""
    weight = F.col(w) if w else F.lit(1)
    edges = df.agg(F.min(x).alias("__mn"), F.max(x).alias("__mx"), F.sum(weight).alias("__tw"))
    wide = F.col("__mx") - F.col("__mn")
    place = F.coalesce(F.floor((F.col(x) - F.col("__mn")) / F.nullif(wide, F.lit(0.0)) * bins), F.lit(0))
    binned = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.least(F.lit(bins - 1), place).cast("int"))  # edges is one row
    one = F.when(wide == 0, F.lit(1.0)).otherwise(wide) / bins
    return binned.groupBy("bin").agg(F.sum(weight).alias("__w"), *[F.first(c).alias(c) for c in ("__mn", "__mx", "__tw")]).select(
        "bin",
        (F.col("__mn") + F.col("bin") * one).alias("left"),
        (F.col("__mn") + (F.col("bin") + 0.5) * one).alias("center"),
        (F.col("__w") / (F.col("__tw") * one)).alias("density"),
    )


def repeated_means(df: DataFrame, n: int, draws: list[Column], x: str = "x") -> DataFrame:
    """``sim, mean``: the mean of ``x`` after each of some systematic resamplings to n, one for each uniform.

    The weights are summed up once and all simulations are counted in one pass.
    """
    c = cumulated(df)
    bounds = [systematic_bound(F.lit(n).cast("long"), u) for u in draws]
    counts = [b(F.col("cw"), F.col("tw")) - b(F.col("cw") - F.col("w"), F.col("tw")) for b in bounds]
    sums = c.agg(F.array(*[F.sum(k * F.col(x)) / n for k in counts]).alias("means"))
    return sums.select(F.posexplode("means").alias("sim", "mean"))


def resampling_variance(means: DataFrame, before: float, n: int) -> Column:
    """Monte-Carlo variance of resampled means: by simulations and, as often printed, by particles."""
    square = F.sum((F.col("mean") - before) * (F.col("mean") - before))
    return F.struct((square / F.count("*")).alias("by_simulations"), (square / n).alias("by_particles"))


def centred_covariance(df: DataFrame, columns: Sequence[str], w: str) -> DataFrame:
    """One row: the upper triangle of the weighted covariance, products taken about the means in a second pass."""
    total = F.sum(w)
    means = df.agg(*[(F.sum(F.col(w) * F.col(c)) / total).alias(f"__m_{c}") for c in columns])
    joined = df.crossJoin(F.broadcast(means))  # one row
    away = {c: F.col(c) - F.col(f"__m_{c}") for c in columns}
    return joined.agg(*[(F.sum(F.col(w) * away[a] * away[b]) / total).alias(f"{a}_{b}") for i, a in enumerate(columns) for b in columns[i:]])
