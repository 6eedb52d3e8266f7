"""Bootstrap, auxiliary and auxiliary interacting-multiple-model filters.

A step takes and gives a particle table; many series run side by side under
``series_id``. All noise is keyed by series, particle and step, so a step that
runs again gives the same set. Weights stay log-weights until a step's largest
is known, so a far observation underflows to equal weights and not to nothing.
Series with small sets are matrix rows instead, see :mod:`.packed`.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import NOISE
from ..lineage import cut, new_path
from . import chunked_schemes, packed, packed_imm, packed_schemes
from .history import History, schema_of, weights_of
from .packed_imm import PAIRS, root_of
from .models import MODELS, BenchmarkModel, RsGarch, constrained
from .resample import ONE, RESAMPLERS, clean, fixed, fixed_from_log, log_of, on_grid, replicated
from .schemes import SCHEMES
from .stats import banded, effective_size, weighted_mean

KEY = ["series_id"]


@dataclass(frozen=True)
class FilterConfig:
    """How a filter runs.

    ``weight_on`` weighs the state before or after the move; ``accumulate``
    multiplies a new weight with the old one or replaces it; a set is
    resampled where its effective size is under ``ess_share`` of n (None:
    always); ``n_out`` lets a step's resampling give another number of rows.
    ``noise`` is ``"keyed"`` or ``"scripted"`` and ``grid`` holds states on
    multiples of 1/grid: with both, any engine repeats a run. Sets of
    ``packed`` particles at most are matrix rows, ``steps_at_once`` steps a job;
    a partitioned run of ``packed_run`` particles at most is a task.
    """

    particles: int = 1000
    parts: int = 1
    seed: int = 0
    dt: float = 1.0
    weight_on: str = "post"
    accumulate: bool = True
    resampler: str = "systematic"
    ess_share: float | None = 0.5
    n_out: int | None = None
    shrink: float = 0.98
    block: int | None = 1 << 16
    noise: str = "keyed"
    grid: float | None = None
    packed: int = 1024
    packed_run: int = 1 << 20
    steps_at_once: int = 256

    @property
    def source(self):
        return NOISE[self.noise](self.seed)


def initial(series: DataFrame, model: BenchmarkModel, config: FilterConfig) -> DataFrame:
    """``series_id, id, part, w, x, parent``: n equal-weight draws per series."""
    rows = series.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config.particles - 1).cast("long"))).alias("id"))
    part = F.floor(F.col("id") * config.parts / config.particles).cast("int")
    x = on_grid(model.init(config.source.normal("init", 0, "series_id", "id")), config.grid)
    return rows.select("series_id", "id", part.alias("part"), F.lit(ONE).cast("long").alias("w"), x.alias("x"), F.col("id").alias("parent"))


def _log(w: str) -> Column:
    return log_of(F.col(w))


def summary(state: DataFrame, t: int) -> DataFrame:
    """``series_id, t, mean, ess, q05, q95`` of a weighted set."""
    means = state.groupBy(*KEY).agg(weighted_mean("x").alias("mean"), effective_size().alias("ess"))
    return means.join(banded(state, "x", KEY), KEY, "left").withColumn("t", F.lit(t))


def weighed(state: DataFrame, observed: DataFrame, t: int, model: BenchmarkModel, config: FilterConfig) -> DataFrame:
    """The set moved to step t and weighed by its observation (``series_id, y``). A series without one only moves."""
    joined = state.join(observed.select("series_id", "y"), KEY, "left")
    time = F.lit(t * config.dt)
    noise = config.source.normal("move", t, "series_id", "id")
    proposed = model.proposal(F.col("x"), F.col("y"), time, noise)
    after = model.propagate(F.col("x"), time, noise)
    after = after if proposed is None else F.coalesce(proposed, after)
    moved = joined.withColumn("__before", F.col("x")).withColumn("x", on_grid(after, config.grid))
    seen = F.col("__before") if config.weight_on == "pre" else F.col("x")
    gain = model.log_likelihood(F.col("y"), seen)
    if proposed is not None:
        gain = gain + model.log_transition(F.col("x"), F.col("__before"), time) - model.log_proposal(F.col("x"), F.col("__before"), F.col("y"), time)
    gain = F.coalesce(gain, F.lit(0.0))
    log_w = _log("w") + gain if config.accumulate else gain
    return fixed_from_log(moved.withColumn("__lw", log_w), "__lw", KEY).drop("__lw", "__before", "y")


def _draw(config: FilterConfig, t: int, *keys: str):
    return lambda i: config.source.uniform("pick", t, "series_id", *keys, *([] if i is None else [i]))


def resampled(state: DataFrame, t: int, config: FilterConfig) -> DataFrame:
    """Equal weights for the series whose effective size is too small; the others keep theirs."""
    n = config.n_out or config.particles
    pick, draw = RESAMPLERS[config.resampler], _draw(config, t)
    if "parent" in state.columns:
        state = state.withColumn("parent", F.col("id"))
    if config.ess_share is None:
        thin, full = state, None
    else:
        sizes = state.groupBy(*KEY).agg(effective_size().alias("__ess"), F.count("*").alias("__n"))
        marked = state.join(sizes, KEY)
        poor = F.col("__ess") < config.ess_share * F.col("__n")
        thin, full = marked.where(poor).drop("__ess", "__n"), marked.where(~poor).drop("__ess", "__n")
    out = replicated(pick(thin, n, draw, KEY, config.block)).withColumn("w", F.lit(ONE).cast("long")).select(*state.columns)
    return out if full is None else out.unionByName(full)


def bootstrap_step(state: DataFrame, observed: DataFrame, t: int, model: BenchmarkModel, config: FilterConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(set after resampling, summary before it, set before it)."""
    now = cut(weighed(state, observed, t, model, config))
    return resampled(now, t, config), summary(now, t), now


def auxiliary_step(state: DataFrame, observed: DataFrame, t: int, model: BenchmarkModel, config: FilterConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Resample by weight times the likelihood of the expected next state, move, and weigh by the ratio. A series without an observation only moves."""
    time, noise = F.lit(t * config.dt), config.source.normal("move", t, "series_id", "id")
    seen = observed.where("y is not null").select("series_id", "y")
    state = state.withColumn("parent", F.col("id"))
    joined = state.join(seen, KEY)
    ahead = joined.withColumn("__ahead", model.log_likelihood(F.col("y"), model.mean(F.col("x"), time)))
    first = cut(fixed_from_log(ahead.withColumn("__lw", _log("w") + F.col("__ahead")), "__lw", KEY).drop("__lw"))
    pick = RESAMPLERS[config.resampler](first, config.particles, _draw(config, t), KEY, config.block)
    move = on_grid(model.propagate(F.col("x"), time, noise), config.grid)
    chosen = replicated(pick).withColumn("x", move)
    second = chosen.withColumn("__lw", model.log_likelihood(F.col("y"), F.col("x")) - F.col("__ahead"))
    idle = state.join(seen, KEY, "left_anti").withColumn("x", move)
    columns = ["series_id", "id", "part", "w", "x", "parent"]
    now = cut(fixed_from_log(second, "__lw", KEY).select(*columns).unionByName(idle.select(*columns)))
    return now, summary(now, t), now


class Told:
    """Summaries of steps, each written in the shared folder as it is made."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.schema, self.steps = spark, new_path(spark, "told"), None, []

    def add(self, said: DataFrame, t: int) -> None:
        said.write.parquet(f"{self.path}/{t}")
        self.schema = said.schema
        self.steps.append(t)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{t}" for t in self.steps])


def _ends(seen: DataFrame) -> DataFrame:
    """``series_id, end``: each series' last step with an observation."""
    return cut(seen.groupBy(*KEY).agg(F.max("t").alias("end")))


def _going(state: DataFrame, ends: DataFrame, t: int) -> DataFrame:
    """The series that have observations after step t."""
    return state.join(ends.where(F.col("end") > t), KEY, "left_semi")


STEPS = {"bootstrap": bootstrap_step, "auxiliary": auxiliary_step}


COLUMNS = ["series_id", "t", "mean", "ess", "q05", "q95"]


def folds(config: FilterConfig, model: BenchmarkModel | RsGarch, series_type: str) -> bool:
    """Whether sets are matrix rows: small, of one size, with a resampler in closed form, and keys and formulas that numpy has."""
    small = config.particles <= config.packed and config.n_out in (None, config.particles) and config.resampler in packed.BOUNDS
    keys = ("bigint", "int") if config.noise == "scripted" else ("bigint", "int", "string")
    return small and not model.columns_only and series_type in keys


def run_filter(observations: DataFrame, model: str | BenchmarkModel = "benchmark", filter_: str = "bootstrap", config: FilterConfig = FilterConfig(), store: str | None = None) -> DataFrame:
    """``series_id, t, mean, ess, q05, q95`` for every step of ``observations(series_id, t, y)``.

    Every series begins at step 1. Rows whose y is null count as no
    observation, of repeated rows of a step the one with the least y counts,
    and a series leaves after its last one. Steps depend on one another;
    series and particles do not. Sets of ``config.packed`` particles at most
    are matrix rows, many series a task and a job for each
    ``config.steps_at_once`` steps; larger ones go step by step, a row per
    particle. Both give the same numbers. ``store`` is a new folder for the
    weighted sets of all steps, see :func:`history_of`. Rows without a
    series_id are left out, and an empty table gives no rows. The filter ``"imm"`` on the model ``"rsgarch"`` is :func:`run_imm`.
    """
    model = MODELS[model]() if isinstance(model, str) else model
    if isinstance(model, RsGarch):
        if filter_ not in HYBRID or store:
            raise ValueError("the model 'rsgarch' has the filters 'bootstrap' and 'imm', and stores no sets")
        return run_hybrid(observations, filter_, config, model)
    if filter_ not in STEPS:
        raise ValueError(f"the filter {filter_!r} is not for this model")
    seen = _seen(observations)
    ends = _ends(seen)
    last, out = ends.agg(F.max("end")).first()[0] or 0, Told(seen.sparkSession)
    if not last:
        return summary(initial(seen, model, config), 0).select(*COLUMNS).where("false")
    history = history_of(observations, store) if store else None
    if not folds(config, model, dict(seen.dtypes)["series_id"]):
        state = _going(initial(seen, model, config), ends, 0)
        for t in range(1, last + 1):
            state, said, now = STEPS[filter_](state, seen.where(F.col("t") == t), t, model, config)
            out.add(said, t)
            if history:
                history.append(now.select("series_id", F.lit(t).alias("t"), "id", "parent", "w", "x"))
            state = cut(_going(state, ends, t))
        return out.rows().select(*COLUMNS)
    advance = lambda rows, keep=False: packed.advanced(rows, model, filter_, config, keep)
    return _fold(ends.select("*", *packed.nothing()), packed.Sets.names, advance, seen, last, config, out, history).select(*COLUMNS)


def history_of(observations: DataFrame, store: str) -> History:
    """The sets that ``run_filter(observations, ..., store=store)`` has left."""
    return History(observations.sparkSession, store, schema_of(dict(observations.dtypes)["series_id"]))


def _seen(observations: DataFrame) -> DataFrame:
    """Observations that count: of a series and a step the least y. Rows without a series belong to none."""
    return cut(observations.where("y is not null and series_id is not null").groupBy("series_id", "t").agg(F.min("y").alias("y")))


def _tasks(sets: DataFrame, last: int, config: FilterConfig) -> int:
    """Tasks for the steps of all series: as many as run at once, more where that is over 2**28 particle steps a task."""
    spark = sets.sparkSession
    work = (sets.agg(F.sum("end")).first()[0] or 0) * config.particles
    return int(max(spark.sparkContext.defaultParallelism, work >> 28))


#: Steps of a job that keeps the sets of all its steps.
KEPT_STEPS = 16


def _fold(sets: DataFrame, names: tuple[str, ...], advance, seen: DataFrame, last: int, config: FilterConfig, out: Told, history: History | None = None) -> DataFrame:
    """The summaries of all steps of ``sets(series_id, end, ...)``, a job for each ``config.steps_at_once`` of them.

    Where all sets are stored, the steps are run once more for that, a few at a
    time: they go to the store as they are made and are held nowhere else.
    """
    tasks = _tasks(sets, last, config)
    span = min(config.steps_at_once, KEPT_STEPS) if history else config.steps_at_once
    for low in range(1, last + 1, span):
        high = low + span - 1
        these = packed.observed(seen.where(F.col("t").between(low, high))).select("series_id", "seen")
        joined = sets.join(these, "series_id", "left")
        # long and short series are dealt out by a hash of their own, whatever the shuffle's partitions are
        rows = joined.select("series_id", *names, F.lit(low).alias("low"), F.least(F.lit(high), "end").cast("int").alias("high"), F.coalesce("seen", F.array().cast("array<struct<t:int,y:double>>")).alias("seen")).repartition(tasks, "series_id")
        after = advance(rows)
        if high < last:
            after = cut(after)
        if history:
            each = _spread(advance(rows, True)).select("series_id", "t", F.posexplode(F.arrays_zip(*names)).alias("id", "of"))
            history.append(each.select("series_id", "t", F.col("id").cast("long").alias("id"), "of.parent", "of.w", "of.x"))
        if high < last:
            sets = cut(after.select("series_id", *names).join(sets.select("series_id", "end").where(F.col("end") > high), "series_id"))
        out.add(_spread(after), low)
    return out.rows()


def _spread(after: DataFrame) -> DataFrame:
    return after.select("series_id", F.inline("said"))


SCHEME_SET = "id long, parent long, part int, lw double, x double"


def scheme_step(now: DataFrame, t: int, y: float, scheme: str, n: int, model: BenchmarkModel, config: FilterConfig) -> DataFrame:
    """The set of step t, as ``SCHEME_SET``, from the weighted set ``id, parent, part, w, x`` of the step before.

    The set before is resampled by the scheme; at the first step it is taken
    as it is. ``scheme`` is None there.
    """
    draw = lambda *keys: config.source.uniform("draw", t - 1, *keys)
    if scheme:
        now = SCHEMES[scheme](now.drop("parent").withColumn("parent", F.col("id")), n, config.parts, draw, draw)
        # a row stands for about 1 of n, so n of its weight is near 1
        now = now.withColumn("w", fixed(F.col("weight") * n))
    time, noise = F.lit(t * config.dt), config.source.normal("move", t, "part", "id")
    moved = now.select("id", "parent", F.col("part").cast("int").alias("part"), "w", F.col("x").alias("before"), on_grid(model.propagate(F.col("x"), time, noise), config.grid).alias("x"))
    gain = model.log_likelihood(F.lit(y), F.col("before") if config.weight_on == "pre" else F.col("x"))
    lw = clean(_log("w") + gain if config.accumulate else gain)
    return moved.select("id", "parent", "part", lw.alias("lw"), "x")


def observed_steps(observations: DataFrame) -> dict[int, float]:
    """The least y of each step of ``observations(t, y)``: one number a step."""
    return {r["t"]: r["y"] for r in observations.where("y is not null").groupBy("t").agg(F.min("y").alias("y")).collect()}


def run_scheme(particles: DataFrame, observations: DataFrame, scheme: str, model: BenchmarkModel, config: FilterConfig, store: str | None = None) -> tuple[DataFrame, DataFrame]:
    """A partitioned filter over one series: (final set, ``t, mean, ess`` of every step before resampling).

    ``particles`` has ``id, part, x`` and ``observations`` has ``t, y``. Each
    step resamples the set by the named scheme, moves and weighs it. A step is
    one job: it reads the set of the step before and writes its own, under
    ``store`` or in the shared folder, as a :class:`.history.History` without
    series. Its largest log-weight is one row that is broadcast, no number
    goes by way of the driver, and the summaries of all steps are one job over
    the stored sets at the end.
    """
    spark = particles.sparkSession
    seen = observed_steps(observations)
    if not seen:
        raise ValueError("there are no observations")
    history = History(spark, store or new_path(spark, f"scheme-{scheme}"), SCHEME_SET, ())
    n, last = config.n_out or particles.count(), None
    for t in sorted(seen):
        if last is None:
            now = particles.select("id", F.col("id").alias("parent"), "part", F.lit(ONE).cast("long").alias("w"), "x")
        else:
            now = weights_of(history.raw(last), [])
        history.write(scheme_step(now, t, seen[t], scheme if last is not None else None, n, model, config), t)
        last = t
    sets = history.weighted()
    said = sets.groupBy("t").agg(weighted_mean("x").alias("mean"), effective_size().alias("ess"))
    return weights_of(history.raw(last), []).select("id", "part", "w", "x"), said


def run_schemes(particles: DataFrame, observations: DataFrame, schemes: tuple[str, ...], model: BenchmarkModel, config: FilterConfig) -> DataFrame:
    """``scheme, t, mean, ess`` of a partitioned run by each scheme, side by side.

    Sets of ``config.packed_run`` particles at most, whose memory is bounded
    by that, take all their steps in a task for each run. Larger sets go step
    by step in chunks of ``config.block`` particles, all runs in the same jobs,
    or, where the model has Columns only, a job for each step and run,
    :func:`run_scheme`. All give the same numbers. Without observations or
    particles there are no rows.
    """
    seen = observed_steps(observations)
    n = particles.count()
    if max(n, config.n_out or 0) <= config.packed_run or not seen or not n:
        return packed_schemes.runs(particles, seen, schemes, model, config)
    if not model.columns_only:
        return chunked_schemes.runs(particles, seen, schemes, model, config, n)

    def run(name):
        return run_scheme(particles, observations, name, model, config)[1].select(F.lit(name).alias("scheme"), "t", "mean", "ess")

    with ThreadPoolExecutor(len(schemes)) as pool:
        return reduce(DataFrame.unionByName, pool.map(inheritable_thread_target(particles.sparkSession)(run), schemes))


# The auxiliary interacting-multiple-model filter with parameter learning.

THETA = [f"p{k}" for k in range(9)]


def imm_initial(series: DataFrame, config: FilterConfig, p0: float = 0.5, model: RsGarch = RsGarch()) -> DataFrame:
    """Equal blocks of particles per mode; a block's particles share its mode's probability. Remainders go to the first modes."""
    rows = series.select("series_id").distinct().select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(config.particles - 1).cast("long"))).alias("id"))
    q = (F.col("id") % model.modes).cast("int")
    weight = F.when(q == 0, p0).otherwise(1 - p0)
    return rows.select("series_id", "id", F.round(weight * ONE).cast("long").alias("w"), *model.init_state("series_id", "id", source=config.source, grid=config.grid), q.alias("q"), *model.parameters("series_id", "id", source=config.source, grid=config.grid))


def p(k: int) -> Column:
    return F.col(f"p{k}")


def imm_moments(state: DataFrame, shrink: float, grid: float | None = None) -> DataFrame:
    """Per series: the next modes' probabilities, parameter means, and their covariance by the shrinkage's rest.

    Products are taken about the means, in a second pass, so a tight set far
    from 0 loses nothing. With ``grid`` means and covariances are multiples of
    1/grid, whose root is then the same to the last bit wherever it is taken.
    """
    model, w = RsGarch(), F.col("w") / F.lit(float(ONE))
    total = F.sum(w)
    mixed = [(F.sum(w * model.mode_probability(i, F.col("q"), F.col("vol"), p)) / total).alias(f"mode{i}") for i in range(model.modes)]
    means = state.groupBy(*KEY).agg(*mixed, *[on_grid(F.sum(w * p(k)) / total, grid).alias(f"m{k}") for k in range(9)])
    away = [p(k) - F.col(f"m{k}") for k in range(9)]
    products = [on_grid((1 - shrink**2) * F.sum(w * away[i] * away[j]) / total, grid).alias(f"c{i}_{j}") for i, j in PAIRS]
    return means.join(state.join(means, KEY).groupBy(*KEY).agg(*products), KEY)


def imm_first_stage(state: DataFrame, moments: DataFrame, observed: DataFrame, shrink: float) -> DataFrame:
    """A row for each particle and next mode, with log first-stage weight and the shrunk parameters m0..m8."""
    model = RsGarch()
    rooted = moments.withColumn("root", root_of(F.array(*[f"c{i}_{j}" for i, j in PAIRS])))  # a row for each series
    joined = state.join(rooted, KEY).join(observed.select("series_id", "y"), KEY)
    shrunk = [(shrink * p(k) + (1 - shrink) * F.col(f"m{k}")).alias(f"m{k}") for k in range(9)]
    keep = ["series_id", "id", "w", "r", "vol", "q", *THETA, "y", *[f"mode{i}" for i in range(model.modes)], "root"]
    wide = joined.select(*keep, *shrunk)
    each = wide.withColumn("mode", F.explode(F.array(*[F.lit(i) for i in range(model.modes)])))
    ahead = model.log_likelihood(F.col("y"), model.predict(p))
    to_mode = F.when(F.col("mode") == 0, model.mode_probability(0, F.col("q"), F.col("vol"), p)).otherwise(model.mode_probability(1, F.col("q"), F.col("vol"), p))
    return each.withColumn("ahead", ahead).withColumn("lw", F.col("ahead") + F.log(to_mode) + _log("w"))


def imm_step(state: DataFrame, observed: DataFrame, t: int, config: FilterConfig) -> tuple[DataFrame, DataFrame]:
    """(set, summary with ``prob_mode0`` and parameter means) after one observation. A series without one only moves."""
    model = RsGarch()
    seen = observed.where("y is not null").select("series_id", "y")
    watched = state.join(seen, KEY, "left_semi")
    first = cut(fixed_from_log(imm_first_stage(watched, imm_moments(watched, config.shrink, config.grid), seen, config.shrink), "lw", ["series_id", "mode"], out="w"))
    keys = ["series_id", "mode"]
    n = F.lit(config.particles // model.modes).cast("long") + F.when(F.col("mode") < config.particles % model.modes, 1).otherwise(0)
    chosen = RESAMPLERS[config.resampler](first, n, _draw(config, t, "mode"), keys, config.block).where("hi > lo")
    copies = chosen.withColumn("id", F.explode(F.sequence(F.col("lo"), F.col("hi") - 1))).withColumn("id", F.col("id") * model.modes + F.col("mode"))
    z = [config.source.normal(f"theta{k}", t, "series_id", "id") for k in range(9)]

    def drawn(i):
        step = sum((F.get("root", PAIRS.index((i, j))) * z[j] for j in range(i + 1)), F.lit(0.0))
        return F.col(f"m{i}") + step

    drawn_columns = copies.select("series_id", "id", "mode", "r", "vol", "y", "mode0", "mode1", "ahead", *[on_grid(drawn(k), config.grid).alias(f"d{k}") for k in range(9)])
    fixed_ = constrained(F.col("d3"), F.col("d4"), F.col("d1"), F.col("d2"))
    theta = drawn_columns.select("series_id", "id", "mode", "r", "vol", "y", "mode0", "mode1", "ahead", F.col("d0").alias("p0"), *fixed_, *[F.col(f"d{k}").alias(f"p{k}") for k in range(5, 9)])
    r, vol = model.propagate(F.col("r"), F.col("vol"), F.col("mode"), p, config.source.normal("move", t, "series_id", "id"))
    moved = theta.withColumn("__r", on_grid(r, config.grid)).withColumn("vol", on_grid(vol, config.grid)).withColumn("r", F.col("__r")).withColumn("q", F.col("mode"))
    share = F.when(F.col("mode") == 0, F.col("mode0")).otherwise(F.col("mode1"))
    second = moved.withColumn("lw", F.log(share) + model.log_likelihood(F.col("y"), F.col("r")) - F.col("ahead"))
    columns = ["series_id", "id", "w", "r", "vol", "q", *THETA]
    idle = turned(state.join(seen, KEY, "left_anti"), t, config)
    now = cut(fixed_from_log(second, "lw", KEY).select(*columns).unionByName(idle.select(*columns)))
    return now, hybrid_summary(now, t)


def turned(state: DataFrame, t: int, config: FilterConfig, model: RsGarch = RsGarch()) -> DataFrame:
    """Particles that draw their next mode and move, and keep weight and parameters."""
    drawn = state.withColumn("q", model.next_mode(F.col("q"), F.col("vol"), p, config.source.uniform("mode", t, "series_id", "id")))
    r, vol = model.propagate(F.col("r"), F.col("vol"), F.col("q"), p, config.source.normal("move", t, "series_id", "id"))
    return drawn.withColumn("__r", on_grid(r, config.grid)).withColumn("vol", on_grid(vol, config.grid)).withColumn("r", F.col("__r")).drop("__r")


def hybrid_summary(now: DataFrame, t: int) -> DataFrame:
    said = now.groupBy(*KEY).agg(
        weighted_mean("r").alias("mean"),
        weighted_mean("vol").alias("vol"),
        effective_size().alias("ess"),
        weighted_mean(F.when(F.col("q") == 0, 1.0).otherwise(0.0)).alias("prob_mode0"),
        *[weighted_mean(p(k)).alias(f"p{k}") for k in range(9)],
    )
    return said.join(banded(now, "r", KEY), KEY, "left").withColumn("t", F.lit(t))


def hybrid_step(state: DataFrame, observed: DataFrame, t: int, config: FilterConfig, model: RsGarch = RsGarch()) -> tuple[DataFrame, DataFrame]:
    """(set after resampling, summary before it) of the bootstrap filter: parameters stay with their particle."""
    moved = turned(state, t, config, model).join(observed.select("series_id", "y"), KEY, "left")
    gain = F.coalesce(model.log_likelihood(F.col("y"), F.col("r")), F.lit(0.0))
    weighed_ = moved.withColumn("__lw", _log("w") + gain if config.accumulate else gain)
    now = cut(fixed_from_log(weighed_, "__lw", KEY).drop("__lw", "y"))
    return resampled(now, t, config), hybrid_summary(now, t)


#: Filters of the hybrid model, each by rows and by matrix rows.
HYBRID = {"imm": (imm_step, packed_imm.ImmSets), "bootstrap": (hybrid_step, packed_imm.HybridSets)}


def run_imm(observations: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """:func:`run_hybrid` with the auxiliary interacting-multiple-model filter, which learns the parameters."""
    return run_hybrid(observations, "imm", config)


def run_hybrid(observations: DataFrame, filter_: str, config: FilterConfig = FilterConfig(), model: RsGarch = RsGarch()) -> DataFrame:
    """``series_id, t, mean, vol, ess, prob_mode0, q05, q95, p0..p8`` for every step, as :func:`run_filter` goes.

    ``"bootstrap"`` moves modes and states under each particle's own
    parameters, known ones or draws from the prior; ``"imm"`` learns them, so
    it is for a model whose parameters are unknown.
    """
    if filter_ == "imm" and model.theta is not None:
        raise ValueError("the filter 'imm' learns parameters; with known ones use 'bootstrap'")
    step, kind = HYBRID[filter_]
    seen = _seen(observations)
    ends = _ends(seen)
    last, out = ends.agg(F.max("end")).first()[0] or 0, Told(seen.sparkSession)
    columns = ["series_id", "t", "mean", "vol", "ess", "prob_mode0", "q05", "q95"]
    if not last:
        return hybrid_summary(imm_initial(seen, config, model=model), 0).select(*columns, *THETA).where("false")
    if folds(config, model, dict(seen.dtypes)["series_id"]):
        sets = cut(ends.select("*", *packed_imm.started(config, model)))
        said = _fold(sets, kind.names, lambda rows: packed_imm.advanced(rows, config, kind), seen, last, config, out)
        return said.select(*columns, *[F.get("p", k).alias(f"p{k}") for k in range(9)])
    state = cut(_going(imm_initial(seen, config, model=model), ends, 0))
    for t in range(1, last + 1):
        state, said = step(state, seen.where(F.col("t") == t), t, config)
        out.add(said, t)
        state = cut(_going(state, ends, t))
    return out.rows().select(*columns, *THETA)
