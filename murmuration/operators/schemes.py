"""Partitioned resampling schemes.

A sub-filter is a value of the column ``part``, never a physical partition.
Input rows have ``id, part, w`` (fixed-point) and state columns; output rows
have a new ``id`` and a ``weight`` that says what share of 1 each stands for.
``u`` gives a uniform in (0, 1) from Columns, so draws are keyed or scripted.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .resample import cumulated, multinomial, systematic, systematic_bound

Draw = Callable[..., Column]
#: Stands in for a sub-filter where one uniform serves the allocation over all of them.
ALLOCATION = 1_000_000
#: Draws that one row spreads into.
DRAWS = 1 << 16


def share_of(n: int, parts: int, part: Column) -> Column:
    """How many of n particles part gets: n div parts, and one more for the first n mod parts."""
    return F.lit(n // parts).cast("long") + F.when(part < n % parts, 1).otherwise(0)


def _new_ids(df: DataFrame, *keys: str) -> DataFrame:
    """Rows for each of lo..hi-1; the id joins the keys and the point."""
    out = df.where("hi > lo").withColumn("__i", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)))
    base = F.lit(0).cast("long")
    for k in keys:
        base = base * (1 << 20) + F.col(k).cast("long")
    return out.withColumn("id", base * (1 << 32) + F.col("__i")).drop("lo", "hi", "cnt", "__i")


def part_sums(df: DataFrame) -> DataFrame:
    """``part, w, n``: weight and rows of each sub-filter."""
    return df.groupBy("part").agg(F.sum("w").alias("w"), F.count("*").alias("n"))


def central(df: DataFrame, n: int, u: Draw) -> DataFrame:
    """Global systematic resampling to n rows of weight 1/n."""
    return _new_ids(systematic(df, n, u(F.lit(0)))).withColumn("weight", F.lit(1.0 / n))


def local(df: DataFrame, n: int, parts: int, u: Draw) -> DataFrame:
    """Each sub-filter by itself to its share of n, all weights 1/n."""
    out = systematic(df, share_of(n, parts, F.col("part")), u(F.col("part")), keys=["part"])
    return _new_ids(out, "part").withColumn("weight", F.lit(1.0 / n))


def _at(part: Column, place: Column) -> Column:
    """A sub-filter and a place in it as one long, which joins sort as a number."""
    return part.cast("long") * (1 << 32) + place


def _ranked(df: DataFrame) -> DataFrame:
    """The state of ``df`` and ``__at``, each row's sub-filter and rank there, by exact prefix sums."""
    rank = cumulated(df.withColumn("__one", F.lit(1).cast("long")), "__one", ["part"])
    return rank.withColumn("__at", _at(F.col("part"), F.col("cw") - 1)).drop("__one", "cw", "tw", "id", "part")


def _taken(draws: DataFrame, rank: DataFrame, parts: int, index: Draw, keys: Sequence[str] = ()) -> DataFrame:
    """The rows that ``draws(keys, part, __n, target, j)`` take from ranked ones; the target is the new part.

    The join is a merge: draws are as many as rows but come from few rows, and
    the planner takes them for small enough to be broadcast.
    """
    drawn = F.floor(index(*map(F.col, keys), F.col("part"), F.col("target"), F.col("j")) * F.col("__n"))
    new_id = _at(F.col("part").cast("long") * parts + F.col("target"), F.col("j"))
    at = draws.select(*keys, _at(F.col("part"), F.least(drawn, F.col("__n") - 1)).alias("__at"), F.col("target").alias("part"), new_id.alias("id"))
    return at.hint("merge").join(rank, "__at").drop("__at")


def _each(parts: int, extra: int) -> Column:
    """How many draws a sub-filter of ``__n`` rows makes for a target."""
    return F.floor(F.col("__n") / parts).cast("long") + extra


def _draws(sizes: DataFrame, parts: int, extra: int = 0, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, part, __n, target, j`` of a selection from ``sizes(keys, part, __n)``; stretches of ``DRAWS`` are dealt over the tasks."""
    targets = sizes.withColumn("__each", _each(parts, extra)).withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where("__each > 0")
    stretches = targets.withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__each") - 1, F.lit(DRAWS).cast("long"))))
    dealt = stretches.repartition(int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.select(*keys, "part", "__n", "target", F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + DRAWS, F.col("__each")) - 1)).alias("j"))


def selected(df: DataFrame, parts: int, index: Draw, extra: int = 0) -> DataFrame:
    """Selection and exchange: every sub-filter draws rows for every target, which become the target's.

    Each draws its rows div parts (and ``extra``) per target, uniformly with
    replacement and whatever their weights, which they keep. ``index(part,
    target, j)`` is the draw. Ranks meet the draws in an equi-join.
    """
    sizes = df.groupBy("part").agg(F.count("*").alias("__n"))
    return _taken(_draws(sizes, parts, extra), _ranked(df), parts, index)


def repeated_selection(df: DataFrame, n: int, parts: int, sims: int, u: Draw, index: Draw) -> DataFrame:
    """``sim, part, weight, mean, resampled``: ``sims`` selections of one set, each then resampled by sub-filter.

    ``weight`` is the sub-filter's share of the simulation's weight, ``mean``
    its weighted mean, and ``resampled`` its mean after the resampling.
    ``index(sim, part, target, j)`` is the draw. The set is ranked once. Of
    the selections, ``sims`` times the set, only the sums of stretches of ids
    are kept; the stretches on which points fall are drawn again.
    """
    keys = ["sim", "part"]
    rank = cut(_ranked(df.select("id", "part", "w", "x")))
    sizes = cut(df.groupBy("part").agg(F.count("*").alias("__n")))
    runs = sizes.withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))))
    # some ten stretches of 2**width ids for a point
    width = max(0, (rank.count() // max(1, n)).bit_length() - 4)
    chosen = _taken(_draws(runs, parts, keys=["sim"]), rank, parts, index, ["sim"])
    sums = cut(chosen.groupBy(*keys, F.shiftright("id", width).alias("stretch")).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("__wx")))
    shares = sums.groupBy(*keys).agg(F.sum("w").alias("w"), (F.sum("__wx") / F.nullif(F.sum("w"), F.lit(0))).alias("mean"))
    totals = shares.groupBy("sim").agg(F.sum("w").alias("tw"))

    bound = systematic_bound(share_of(n, parts, F.col("part")), u(F.col("sim"), F.col("part")))
    points = lambda low, high: bound(high, F.col("tw")) - bound(low, F.col("tw"))
    running = cumulated(sums, "w", keys, "stretch").withColumn("__base", F.col("cw") - F.col("w"))
    hit = running.where(points(F.col("__base"), F.col("cw")) > 0).select(*keys, "stretch", "__base", "tw")
    first = F.shiftleft("stretch", width)
    ids = hit.select(*keys, "stretch", "__base", "tw", F.explode(F.sequence(first, first + (1 << width) - 1)).alias("id"))
    source = F.shiftright("id", 32)
    again = ids.select("sim", F.col("part").alias("target"), "stretch", "__base", "tw", ((source - F.col("part")) / parts).cast("int").alias("part"), (F.col("id") - F.shiftleft(source, 32)).alias("j"))
    again = again.join(F.broadcast(sizes), "part").where(F.col("j") < _each(parts, 0))  # a row for each sub-filter
    more = ["sim", "stretch", "__base", "tw"]
    inside = Window.partitionBy(*keys, "stretch").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    found = _taken(again, rank, parts, lambda sim, b, base, tw, *place: index(sim, *place), more).withColumn("cw", F.col("__base") + F.sum("w").over(inside))
    counted = found.withColumn("cnt", points(F.col("cw") - F.col("w"), F.col("cw")))
    resampled = counted.groupBy(*keys).agg((F.sum(F.col("cnt") * F.col("x")) / F.nullif(F.sum("cnt"), F.lit(0))).alias("resampled"))
    return shares.join(totals, "sim").join(resampled, keys, "left").select(*keys, (F.col("w") / F.col("tw")).alias("weight"), "mean", "resampled")


def dpf(df: DataFrame, n: int, parts: int, u: Draw, index: Draw) -> DataFrame:
    """Selection and exchange, then each sub-filter by itself."""
    return local(selected(df, parts, index), n, parts, u)


def dist1(df: DataFrame, n: int, parts: int, u: Draw) -> DataFrame:
    """Each sub-filter to its share; weights keep the sub-filter's share of the total.

    With fewer rows than sub-filters some get none; the others share out their weight.
    """
    mine = share_of(n, parts, F.col("part"))
    sums = part_sums(df).where(mine > 0).select("part", F.col("w").alias("__wp"))
    total = sums.agg(F.sum("__wp").alias("__wt"))
    out = _new_ids(systematic(df, mine, u(F.col("part")), keys=["part"]), "part")
    return out.join(F.broadcast(sums.crossJoin(total)), "part").withColumn("weight", F.col("__wp") / F.col("__wt") / mine).drop("__wp", "__wt")


def allocated(df: DataFrame, n: int, u: Draw) -> DataFrame:
    """``part, w, cnt``: n dealt over sub-filters systematically by their weights."""
    return systematic(part_sums(df), n, u(F.lit(ALLOCATION)), order="part").select("part", "w", "cnt")


def allocated_by_draws(df: DataFrame, n: int, u: Draw) -> DataFrame:
    """``part, w, cnt``: n draws over sub-filters by their weights."""
    draws = df.sparkSession.range(n).select(u(F.col("id")).alias("u"))
    sums = part_sums(df).withColumn("part", F.col("part").cast("long"))
    return multinomial(sums, draws, 1 << 10, order="part").select("part", "w", "cnt")


def _to_counts(df: DataFrame, counts: DataFrame, n: int, u: Draw) -> DataFrame:
    """Each sub-filter by itself to the rows it was dealt; sub-filters are few, so their table is broadcast."""
    dealt = df.join(F.broadcast(counts.select(F.col("part").cast("int").alias("part"), F.col("cnt").alias("__n"))), "part")
    return _new_ids(systematic(dealt, F.col("__n"), u(F.col("part")), keys=["part"]), "part").withColumn("weight", F.lit(1.0 / n)).drop("__n")


def dist2(df: DataFrame, n: int, u: Draw) -> DataFrame:
    """Systematic allocation over sub-filters, then each by itself."""
    return _to_counts(df, allocated(df, n, u), n, u)


def hierarchical(df: DataFrame, n: int, u: Draw, draw: Draw) -> DataFrame:
    """Multinomial allocation over sub-filters, then each by itself."""
    return _to_counts(df, allocated_by_draws(df, n, draw), n, u)


def dist3(df: DataFrame, n: int, parts: int, u: Draw) -> DataFrame:
    """Whole sub-filters drawn by weight, each copy resampled by itself to its share with a draw of its own."""
    drawn = systematic(part_sums(df), parts, u(F.lit(ALLOCATION)), order="part").where("hi > lo")
    copies = drawn.select("part", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1)).alias("__copy"))
    many = df.join(F.broadcast(copies), "part").drop("part").withColumn("part", F.col("__copy").cast("int")).drop("__copy")
    return local(many, n, parts, u)


def decentral(df: DataFrame, u: Draw) -> DataFrame:
    """Each sub-filter to as many rows as it has; weight its share of the total by row."""
    sums = part_sums(df).select("part", F.col("w").alias("__wp"), F.col("n").alias("__np"))
    total = sums.agg(F.sum("__wp").alias("__wt"))
    dealt = df.join(F.broadcast(sums.crossJoin(total)), "part")
    out = _new_ids(systematic(dealt, F.col("__np"), u(F.col("part")), keys=["part"]), "part")
    return out.withColumn("weight", F.col("__wp") / F.col("__np") / F.col("__wt")).drop("__wp", "__np", "__wt")


def subset(df: DataFrame, n: int, parts: int, u: Draw, index: Draw) -> DataFrame:
    """Selection with one draw more per target, then each sub-filter by itself to n div parts."""
    chosen = selected(df, parts, index, extra=1)
    return _new_ids(systematic(chosen, n // parts, u(F.col("part")), keys=["part"]), "part").withColumn("weight", F.lit(1.0 / n))


#: Schemes by name, called as f(df, n, parts, u, draws).
SCHEMES = {
    "cen": lambda df, n, parts, u, draw: central(df, n, u),
    "dpf": lambda df, n, parts, u, draw: dpf(df, n, parts, u, draw),
    "dpf_noshuffle": lambda df, n, parts, u, draw: local(df, n, parts, u),
    "dist1": lambda df, n, parts, u, draw: dist1(df, n, parts, u),
    "dist2": lambda df, n, parts, u, draw: dist2(df, n, u),
    "dist3": lambda df, n, parts, u, draw: dist3(df, n, parts, u),
    "decen": lambda df, n, parts, u, draw: decentral(df, u),
    "sub": lambda df, n, parts, u, draw: subset(df, n, parts, u, draw),
    "hiera": lambda df, n, parts, u, draw: hierarchical(df, n, u, draw),
}
