"""Queries of model kernels and statistics over event and order particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rng import lcg, normal, uniform
from ..operators.filters import imm_moments, p
from ..operators.models import BenchmarkModel, GrowthModel, RsGarch, constrained
from ..operators.resample import ONE
from ..operators.stats import effective_size, histogram, integral, mean_and_variance, banded, mode_probability, weighted_mean, weighted_quantiles
from ..lineage import new_path
from ..sources.simulate import simulated
from ..sources.steps import read_steps, write_observations
from ..sources.tables import event_particles, event_series, table, weighted_events
from ..sources.text import observation

Y, T = 5.609, 1.0
#: SQL of the scripted noise and of event particles, shared by the statements below.
LCG = "((CAST({0} AS BIGINT) * 1103515245 + 12345) % 2147483648 / 2147483648.0::DOUBLE)"
MEAN = "({x} / 2 + 25 * {x} / (1 + {x} * {x}) + 8 * cos(1.2::DOUBLE * {t}))"
ROOT_10, ROOT_2PI = "3.1622776601683795::DOUBLE", "2.5066282746310002::DOUBLE"
EVENTS = "e AS (SELECT event_id AS id, CAST(user_id % 4 AS INT) AS part, value / 25.0::DOUBLE - 10.0::DOUBLE AS x FROM events)"


def lcg_sql(i: str) -> str:
    return LCG.format(i)


def mean_sql(x: str = "x", t: str = "1.0::DOUBLE") -> str:
    return MEAN.format(x=x, t=t)


def pdf_sql(x: str, mean: str, sd: str = "1.0::DOUBLE") -> str:
    return f"(exp(-0.5::DOUBLE * (({x} - ({mean})) / {sd}) * (({x} - ({mean})) / {sd})) / ({ROOT_2PI} * {sd}))"


MOVED = f"m AS (SELECT id, part, {mean_sql()} + (2 * {lcg_sql('id')} - 1) * {ROOT_10} AS x FROM e)"
WEIGHED = f"{EVENTS}, {MOVED}, p AS (SELECT id, part, x, CAST(round({pdf_sql(f'{Y}::DOUBLE', 'x * x / 20')} * 4294967296.0::DOUBLE) AS BIGINT) AS w FROM m)"


def _w(spark, sf_dir):
    return weighted_events(spark, sf_dir, Y, T)


# observations


def _observations(spark, sf_dir):
    return event_series(spark, sf_dir)


def obs_first(spark, sf_dir):
    return observation(_observations(spark, sf_dir), 1).select("series_id", F.round("y", 6).alias("y"))


def obs_seek(spark, sf_dir):
    return observation(_observations(spark, sf_dir), 5).select("series_id", F.round("y", 6).alias("y"))


def _obs_sql(step: int) -> str:
    return f"""SELECT series_id, round(y, 6) AS y FROM (
      SELECT user_id AS series_id, value / 25.0::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t = {step}"""


#: Steps of a folder of the stored series, and the steps read back.
WIDTH, READ = 4, (5, 7)


def obs_stored(spark, sf_dir):
    """Some steps of the series' store, whose other folders aren't read."""
    path = new_path(spark, "observations")
    write_observations(_observations(spark, sf_dir), path, WIDTH)
    return read_steps(spark, path, *READ).select("series_id", F.col("t").cast("int").alias("t"), F.round("y", 6).alias("y"))


_STORED = f"""SELECT series_id, CAST(t AS INT) AS t, round(y, 6) AS y FROM (
      SELECT user_id AS series_id, value / 25.0::DOUBLE AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events) WHERE t BETWEEN {READ[0]} AND {READ[1]}"""


def simulate_growth(spark, sf_dir):
    """Eight steps from each event's state, with scripted noise."""
    starts = event_particles(spark, sf_dir)
    noise = lambda t, kind: 2 * lcg(F.col("id") * 31 + t * 7 + (0 if kind == "x" else 3)) - 1
    out = simulated(starts.withColumnRenamed("x", "x0"), BenchmarkModel(), 8, F.col("x0"), noise)
    return out.select("id", "t", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


_SIMULATE = f"""WITH RECURSIVE {EVENTS},
 s(id, t, x) AS (SELECT id, 0, x FROM e UNION ALL
  SELECT id, t + 1, {mean_sql('x', '(t + 1)::DOUBLE')} + (2 * {lcg_sql('(id * 31 + (t + 1) * 7)')} - 1) * {ROOT_10} FROM s WHERE t < 8)
 SELECT id, t, round(x, 5) AS x, round(x * x / 20 + 2 * {lcg_sql('(id * 31 + t * 7 + 3)')} - 1, 5) AS y FROM s WHERE t > 0"""


# model kernels


def propagate_mean(spark, sf_dir):
    return event_particles(spark, sf_dir).select("id", "part", F.round(BenchmarkModel().mean(F.col("x"), F.lit(T)), 6).alias("x1"))


def obs_density_pre(spark, sf_dir):
    model = BenchmarkModel()
    return event_particles(spark, sf_dir).select("id", F.round(model.likelihood(Y, F.col("x")), 9).alias("w"), F.round(model.mean(F.col("x"), F.lit(T)), 6).alias("x1"))


def obs_density_post(spark, sf_dir):
    model = BenchmarkModel()
    moved = event_particles(spark, sf_dir).select("id", model.mean(F.col("x"), F.lit(T)).alias("x1"))
    return moved.select("id", F.round(model.likelihood(Y, F.col("x1")), 9).alias("w"), F.round("x1", 6).alias("x1"))


def tran_density(spark, sf_dir):
    moved = event_particles(spark, sf_dir).withColumn("x1", BenchmarkModel().propagate(F.col("x"), F.lit(T), 2 * lcg("id") - 1))
    return moved.select("id", F.round(BenchmarkModel().transition_pdf(F.col("x1"), F.col("x"), F.lit(T)), 9).alias("density"))


def growth_variant(spark, sf_dir):
    """The variant's move, lagged density and expected state at t = 2."""
    model, t = GrowthModel(), F.lit(2.0)
    moved = event_particles(spark, sf_dir).withColumn("x1", model.propagate(F.col("x"), t, 2 * lcg("id") - 1))
    return moved.select(
        "id",
        F.round("x1", 6).alias("x1"),
        F.round(model.transition_pdf(F.col("x1"), F.col("x"), t), 9).alias("density"),
        F.round(model.mean(F.col("x"), t), 6).alias("expected"),
        F.round(model.likelihood(Y, F.col("x1")), 9).alias("likelihood"),
    )


_G = "((x - 1) / 2 + 25 * x / (1 + x * x) + 8 * cos(1.2::DOUBLE * {t}))"


def _garch_rows(spark, sf_dir):
    """Orders as regime-switching particles: scripted parameters, weight by price."""
    u = lambda k: lcg(F.col("o_orderkey") * 9 + k)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.lit(0).cast("long").alias("series_id"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("w"),
        (F.col("o_orderkey") % 2).cast("int").alias("q"),
        (2 * u(0) - 1).alias("r"),
        (u(1) + 0.1).alias("vol"),
        (u(2) - 0.5).alias("p0"),
        (u(3) - 0.1).alias("p1"),
        (u(4) + 0.2).alias("p2"),
        (u(5) - 0.2).alias("p3"),
        (u(6) + 0.2).alias("p4"),
        *[(u(k + 2) * 4 - 2).alias(f"p{k}") for k in range(5, 9)],
    )


def _garch_sql() -> str:
    u = lambda k: lcg_sql(f"(o_orderkey * 9 + {k})")
    more = ", ".join(f"{u(k + 2)} * 4 - 2 AS p{k}" for k in range(5, 9))
    return f"""g AS (SELECT o_orderkey AS id, CAST(round(o_totalprice * 100) AS BIGINT) AS w, CAST(o_orderkey % 2 AS INT) AS q,
      2 * {u(0)} - 1 AS r, {u(1)} + 0.1::DOUBLE AS vol, {u(2)} - 0.5::DOUBLE AS p0, {u(3)} - 0.1::DOUBLE AS p1, {u(4)} + 0.2::DOUBLE AS p2,
      {u(5)} - 0.2::DOUBLE AS p3, {u(6)} + 0.2::DOUBLE AS p4, {more} FROM orders)"""


_STAY0, _STAY1 = "(1.0::DOUBLE / (1 + exp(p5 + p7 * vol)))", "(1.0::DOUBLE / (1 + exp(p6 + p8 * vol)))"
_TO0, _TO1 = f"(CASE WHEN q = 0 THEN {_STAY0} ELSE 1 - {_STAY1} END)", f"(CASE WHEN q = 1 THEN {_STAY1} ELSE 1 - {_STAY0} END)"


def rsgarch_vol(spark, sf_dir):
    return _garch_rows(spark, sf_dir).select("id", F.round(RsGarch.volatility(F.col("r"), F.col("vol"), F.col("q"), p), 6).alias("vol"))


def rsgarch_regime(spark, sf_dir):
    model, rows = RsGarch(), _garch_rows(spark, sf_dir)
    to = [model.mode_probability(i, F.col("q"), F.col("vol"), p) for i in range(2)]
    return rows.select("id", F.round(to[0], 6).alias("to0"), F.round(to[1], 6).alias("to1"), model.next_mode(F.col("q"), F.col("vol"), p, lcg(F.col("id") + 77)).cast("int").alias("next_q"))


def rsgarch_density(spark, sf_dir):
    model, rows = RsGarch(), _garch_rows(spark, sf_dir)
    return rows.select("id", F.round(model.return_pdf(F.col("r"), F.col("vol"), p), 8).alias("density"), F.round(model.likelihood(0.25, F.col("r")), 8).alias("likelihood"))


def param_constraints(spark, sf_dir):
    """Parameters in range, and how they were moved."""
    rows = _garch_rows(spark, sf_dir)
    return rows.select("id", *[F.round(c, 6).alias(f"c{k}") for k, c in zip((1, 2, 3, 4), constrained(p(3), p(4), p(1), p(2)), strict=True)])


# statistics


def normalize_weights(spark, sf_dir):
    w = _w(spark, sf_dir)
    total = w.agg(F.sum("w").alias("tw"))  # one row
    return w.crossJoin(F.broadcast(total)).select("id", F.round(F.col("w") / F.col("tw"), 12).alias("w"))


def ess(spark, sf_dir):
    """Effective size and mean of each sub-filter and of all (part -1)."""
    w = _w(spark, sf_dir)
    said = [F.round(effective_size(), 4).alias("ess"), F.round(weighted_mean("x"), 6).alias("mean"), F.count("*").alias("n")]
    return w.groupBy("part").agg(*said).unionByName(w.agg(*said).withColumn("part", F.lit(-1)))


def weighted_mean_query(spark, sf_dir):
    return _w(spark, sf_dir).groupBy("part").agg(F.round(weighted_mean("x"), 6).alias("mean"), *[F.round(c, 6).alias(n) for c, n in zip(mean_and_variance("x"), ("plain_mean", "variance"), strict=True)])


def param_means(spark, sf_dir):
    return _garch_rows(spark, sf_dir).agg(*[F.round(weighted_mean(f"p{k}"), 6).alias(f"p{k}") for k in range(9)])


def quantile_band_query(spark, sf_dir):
    return banded(_w(spark, sf_dir), "x", ["part"]).select("part", F.round("q05", 6).alias("q05"), F.round("q95", 6).alias("q95"))


def weighted_quantile(spark, sf_dir):
    return weighted_quantiles(_w(spark, sf_dir), "x", "w", [0.05, 0.5, 0.95]).select("prob", F.round("value", 6).alias("value"))


def mode_prob(spark, sf_dir):
    return _garch_rows(spark, sf_dir).agg(F.round(mode_probability(), 9).alias("prob_mode0"))


def histogram_weighted(spark, sf_dir):
    h = histogram(_w(spark, sf_dir), "x", "w", 50)
    return h.select("bin", F.round("center", 6).alias("center"), F.round("density", 9).alias("density"))


def histogram_plain(spark, sf_dir):
    h = histogram(_w(spark, sf_dir), "x", None, 100)
    return h.select("bin", F.round("center", 6).alias("center"), F.round("density", 9).alias("density"))


def _histogram_sql(w: str, bins: int) -> str:
    return f"""WITH {WEIGHED}, s AS (SELECT min(x) AS mn, max(x) AS mx, sum({w}) AS tw FROM p),
      b AS (SELECT least({bins - 1}, CAST(floor((x - mn) / (mx - mn) * {bins}) AS INT)) AS bin, {w} AS v, mn, mx, tw FROM p, s)
      SELECT bin, round(any_value(mn) + (bin + 0.5::DOUBLE) * ((any_value(mx) - any_value(mn)) / {bins}), 6) AS center,
        round(sum(v) / (any_value(tw) * ((any_value(mx) - any_value(mn)) / {bins})), 9) AS density FROM b GROUP BY bin"""


def integrate_fn(spark, sf_dir):
    """Expectations of functions of the state."""
    w = _w(spark, sf_dir)
    square, big = integral(F.col("x") * F.col("x")), integral(F.when(F.abs("x") > 5, 1.0).otherwise(0.0))
    return w.groupBy("part").agg(F.round(square, 6).alias("square"), F.round(big, 9).alias("beyond_5"))


def imm_mode_mix(spark, sf_dir):
    return imm_moments(_garch_rows(spark, sf_dir), 0.98).select(F.round("mode0", 9).alias("mode0"), F.round("mode1", 9).alias("mode1"))


def liu_west_shrink(spark, sf_dir):
    rows = _garch_rows(spark, sf_dir)
    moments = imm_moments(rows, 0.98)
    return rows.join(F.broadcast(moments), "series_id").select("id", *[F.round(0.98 * p(k) + 0.02 * F.col(f"m{k}"), 6).alias(f"p{k}") for k in range(9)])


def param_cov(spark, sf_dir):
    moments = imm_moments(_garch_rows(spark, sf_dir), 0.98)
    return moments.select(*[F.round(f"c{i}_{j}", 7).alias(f"c{i}_{j}") for i in range(9) for j in range(i + 1)])


_COV = ", ".join(f"round((1 - 0.98::DOUBLE * 0.98::DOUBLE) * (sum(v * p{i} * p{j}) / sum(v) - sum(v * p{i}) / sum(v) * (sum(v * p{j}) / sum(v))), 7) AS c{i}_{j}" for i in range(9) for j in range(i + 1))


def keyed_rng_moments(spark, sf_dir):
    """Moments of keyed draws, one stream per event."""
    e = event_particles(spark, sf_dir).select(normal("id", seed=7).alias("z"), uniform("id", seed=7).alias("u"))
    return e.agg(*[F.round(c, 9).alias(n) for n, c in {"mean": F.avg("z"), "sd": F.stddev_samp("z"), "skew": F.skewness("z"), "kurtosis": F.kurtosis("z"), "u_mean": F.avg("u")}.items()])


def vector_mean(spark, sf_dir):
    """Mean vector of embeddings by label: states of many dimensions."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v"))
    return e.groupBy("label", "dim").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


QUERIES = {
    "obs_first": (obs_first, _obs_sql(1)),
    "obs_seek": (obs_seek, _obs_sql(5)),
    "obs_stored": (obs_stored, _STORED),
    "simulate_growth": (simulate_growth, _SIMULATE),
    "propagate_mean": (propagate_mean, f"WITH {EVENTS} SELECT id, part, round({mean_sql()}, 6) AS x1 FROM e"),
    "obs_density_pre": (obs_density_pre, f"WITH {EVENTS} SELECT id, round({pdf_sql(f'{Y}::DOUBLE', 'x * x / 20')}, 9) AS w, round({mean_sql()}, 6) AS x1 FROM e"),
    "obs_density_post": (
        obs_density_post,
        f"WITH {EVENTS}, v AS (SELECT id, {mean_sql()} AS z FROM e) SELECT id, round({pdf_sql(f'{Y}::DOUBLE', 'z * z / 20')}, 9) AS w, round(z, 6) AS x1 FROM v",
    ),
    "tran_density": (
        tran_density,
        f"WITH {EVENTS}, v AS (SELECT id, x, {mean_sql()} + (2 * {lcg_sql('id')} - 1) * {ROOT_10} AS z FROM e) SELECT id, round({pdf_sql('z', mean_sql(), ROOT_10)}, 9) AS density FROM v",
    ),
    "growth_variant": (
        growth_variant,
        f"""WITH {EVENTS}, v AS (SELECT id, x, {_G.format(t='2.0::DOUBLE')} + (2 * {lcg_sql('id')} - 1) * {ROOT_10} AS z, {_G.format(t='1.0::DOUBLE')} AS ex FROM e)
        SELECT id, round(z, 6) AS x1, round({pdf_sql('z', 'ex', ROOT_10)}, 9) AS density, round(ex, 6) AS expected, round({pdf_sql(f'{Y}::DOUBLE', 'z * z / 20')}, 9) AS likelihood FROM v""",
    ),
    "rsgarch_vol": (rsgarch_vol, f"WITH {_garch_sql()} SELECT id, round(CASE WHEN q = 0 THEN p1 ELSE p2 END + p3 * (r - p0) * (r - p0) + p4 * vol, 6) AS vol FROM g"),
    "rsgarch_regime": (
        rsgarch_regime,
        f"""WITH {_garch_sql()} SELECT id, round({_TO0}, 6) AS to0, round({_TO1}, 6) AS to1,
        CAST(CASE WHEN {lcg_sql('(id + 77)')} < CASE WHEN q = 0 THEN {_STAY0} ELSE {_STAY1} END THEN q ELSE 1 - q END AS INT) AS next_q FROM g""",
    ),
    "rsgarch_density": (
        rsgarch_density,
        f"WITH {_garch_sql()} SELECT id, round({pdf_sql('r', 'p0', 'sqrt(vol)')}, 8) AS density, round({pdf_sql('0.25::DOUBLE', 'r')}, 8) AS likelihood FROM g",
    ),
    "param_constraints": (
        param_constraints,
        f"""WITH {_garch_sql()} SELECT id, round(greatest(p1, 0), 6) AS c1, round(greatest(p2, 0), 6) AS c2, round(greatest(p3, 0), 6) AS c3,
        round(CASE WHEN greatest(p3, 0) + p4 > 1 THEN 1 - greatest(p3, 0) ELSE p4 END, 6) AS c4 FROM g""",
    ),
    "normalize_weights": (normalize_weights, f"WITH {WEIGHED} SELECT id, round(w / CAST((SELECT sum(w) FROM p) AS DOUBLE), 12) AS w FROM p"),
    "ess": (
        ess,
        f"""WITH {WEIGHED}, d AS (SELECT part, x, CAST(w AS DOUBLE) AS w FROM p), z AS (SELECT * FROM d UNION ALL SELECT -1, x, w FROM d)
        SELECT part, round(sum(w) * sum(w) / sum(w * w), 4) AS ess, round(sum(w * x) / sum(w), 6) AS mean, count(*) AS n FROM z GROUP BY part""",
    ),
    "weighted_mean": (
        weighted_mean_query,
        f"WITH {WEIGHED} SELECT part, round(sum(w * x) / sum(w), 6) AS mean, round(avg(x), 6) AS plain_mean, round(var_pop(x), 6) AS variance FROM p GROUP BY part",
    ),
    "param_means": (param_means, f"WITH {_garch_sql()} SELECT " + ", ".join(f"round(sum(w * p{k}) / sum(w), 6) AS p{k}" for k in range(9)) + " FROM g"),
    "quantile_band": (quantile_band_query, f"WITH {WEIGHED} SELECT part, round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.95), 6) AS q95 FROM p GROUP BY part"),
    "weighted_quantile": (
        weighted_quantile,
        f"""WITH {WEIGHED}, c AS (SELECT x, sum(w) OVER (ORDER BY x RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(w) OVER () AS tw FROM p WHERE w > 0)
        SELECT prob::DOUBLE AS prob, round(min(x), 6) AS value FROM c, (VALUES (0.05::DOUBLE), (0.5::DOUBLE), (0.95::DOUBLE)) AS v(prob) WHERE cw >= prob * tw GROUP BY prob""",
    ),
    "mode_prob": (mode_prob, f"WITH {_garch_sql()} SELECT round(CAST(sum(CASE WHEN q = 0 THEN w ELSE 0 END) AS DOUBLE) / sum(w), 9) AS prob_mode0 FROM g"),
    "histogram_weighted": (histogram_weighted, _histogram_sql("w", 50)),
    "histogram_plain": (histogram_plain, _histogram_sql("1", 100)),
    "integrate_fn": (
        integrate_fn,
        f"WITH {WEIGHED} SELECT part, round(sum(w * (x * x)) / sum(w), 6) AS square, round(sum(w * CASE WHEN abs(x) > 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / sum(w), 9) AS beyond_5 FROM p GROUP BY part",
    ),
    "imm_mode_mix": (
        imm_mode_mix,
        f"WITH {_garch_sql()}, v AS (SELECT *, w / {float(ONE)}::DOUBLE AS v FROM g) SELECT round(sum(v * {_TO0}) / sum(v), 9) AS mode0, round(sum(v * {_TO1}) / sum(v), 9) AS mode1 FROM v",
    ),
    "liu_west_shrink": (
        liu_west_shrink,
        f"WITH {_garch_sql()}, s AS (SELECT " + ", ".join(f"sum(w * p{k}) / sum(w) AS m{k}" for k in range(9)) + " FROM g) SELECT id, " + ", ".join(f"round(0.98::DOUBLE * p{k} + 0.02::DOUBLE * m{k}, 6) AS p{k}" for k in range(9)) + " FROM g, s",
    ),
    "param_cov": (param_cov, f"WITH {_garch_sql()}, v AS (SELECT *, w / {float(ONE)}::DOUBLE AS v FROM g) SELECT {_COV} FROM v"),
    "keyed_rng_moments": (keyed_rng_moments, None),
    "vector_mean": (
        vector_mean,
        "SELECT label, CAST(dim - 1 AS INT) AS dim, round(avg(v), 6) AS mean FROM (SELECT label, unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) GROUP BY label, dim",
    ),
}
