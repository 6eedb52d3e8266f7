"""Queries that run whole filters over the tables, and the comparison of all schemes."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import uniform
from ..lineage import cut, new_path
from ..operators.filters import THETA, FilterConfig, history_of, imm_initial, run_filter, run_imm, run_schemes
from ..operators.models import BenchmarkModel
from ..operators.schemes import SCHEMES
from ..operators.stats import effective_size, weighted_mean
from ..sources.tables import event_particles, event_series, table
from ..streaming.live import live_filter, live_session
from ..streaming.online import OnlineFilter
from .imm_sql import imm_prior_sql, imm_sql
from .kernels import _w
from .scheme_sql import schemes_sql
from .whole_sql import auxiliary_sql, bootstrap_sql, guided_sql, stored_ancestors_sql, stored_ess_sql, stored_integral_sql

CONFIG = FilterConfig(particles=64, seed=3, noise="scripted", grid=float(1 << 20))


def scheme_comparison(spark: SparkSession, sf_dir: str, n: int = 10_000, parts: int = 4) -> DataFrame:
    """``scheme, n, mean, ess`` before and after resampling one weighted set by every scheme."""
    rows = cut(_w(spark, sf_dir))
    said = lambda df, name, w: df.agg(F.count("*").alias("n"), F.round(weighted_mean("x", w), 6).alias("mean"), F.round(effective_size(w), 3).alias("ess")).select(F.lit(name).alias("scheme"), "n", "mean", "ess")
    out = [said(rows, "before", "w")]
    for name, scheme in SCHEMES.items():
        u = lambda *keys, name=name: uniform(*keys, seed=9, tag=name)
        out.append(said(scheme(rows, n, parts, u, u), name, "weight"))
    return reduce(DataFrame.unionByName, out)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("series_id", F.col("t").cast("int").alias("t"), *[F.round(c, 6).alias(c) for c in ("mean", "ess", "q05", "q95")])


def bootstrap_run(spark, sf_dir):
    return _rounded(run_filter(event_series(spark, sf_dir), "benchmark", "bootstrap", CONFIG))


#: The step that the queries of stored sets go back to, and how far their ancestors do.
STORED_STEP, BACK_TO = 5, 2


def _stored(spark, sf_dir):
    """Sets of all steps of ``bootstrap_run``."""
    seen, path = event_series(spark, sf_dir), new_path(spark, "history")
    run_filter(seen, "benchmark", "bootstrap", CONFIG, store=path)
    return history_of(seen, path)


def stored_ess(spark, sf_dir):
    """Effective sizes at an earlier step."""
    return _stored(spark, sf_dir).effective_size(STORED_STEP).select("series_id", "t", F.round("ess", 6).alias("ess"))


def stored_integral(spark, sf_dir):
    """The mean of x squared at an earlier step."""
    found = _stored(spark, sf_dir).integral(F.col("x") * F.col("x"), STORED_STEP)
    return found.select("series_id", "t", F.round("value", 6).alias("value"))


def stored_ancestors(spark, sf_dir):
    """Paths of an earlier step's particles through their ancestors."""
    return _stored(spark, sf_dir).ancestors(STORED_STEP, BACK_TO).withColumn("x", F.round("x", 6))


def apf_run(spark, sf_dir):
    return _rounded(run_filter(event_series(spark, sf_dir), "growth", "auxiliary", CONFIG))


def guided_run(spark, sf_dir):
    """The bootstrap filter with a proposal that looks at the observation."""
    return _rounded(run_filter(event_series(spark, sf_dir), "guided", "bootstrap", CONFIG))


def _hybrid_rounded(df: DataFrame) -> DataFrame:
    return df.select("series_id", F.col("t").cast("int").alias("t"), *[F.round(c, 6).alias(c) for c in df.columns if c not in ("series_id", "t")])


def aux_imm_run(spark, sf_dir):
    """The filter that learns modes and parameters, over every event of every user."""
    return _hybrid_rounded(run_imm(event_series(spark, sf_dir), CONFIG))


def imm_prior(spark, sf_dir):
    """First sets of all users: states, modes and parameters from their priors."""
    first = imm_initial(event_series(spark, sf_dir), CONFIG)
    return first.select("series_id", "id", "w", "q", *[F.round(c, 6).alias(c) for c in ("r", "vol", *THETA)])


#: The Spark side of the study weighs before the move and multiplies weights; its MapReduce side weighs after and replaces them.
SPARK_SIDE = FilterConfig(parts=4, seed=21, noise="scripted", grid=float(1 << 20), weight_on="pre", accumulate=True)
MR_SIDE = replace(SPARK_SIDE, weight_on="post", accumulate=False)


def _scheme_runs(spark, sf_dir, names, config) -> DataFrame:
    """Partitioned filters over the users' mean values, every event a particle; the schemes run side by side.

    The observation of a step is the mean over the users' events of that place.
    """
    seen = event_series(spark, sf_dir).groupBy(F.col("t").cast("int").alias("t")).agg(F.avg("y").alias("y"))
    said = run_schemes(cut(event_particles(spark, sf_dir)), seen, names, BenchmarkModel(), config)
    return said.select("scheme", "t", F.round("mean", 6).alias("mean"), F.round("ess", 6).alias("ess"))


SPARK_SCHEMES = ("dpf", "dpf_noshuffle", "cen", "dist1", "dist2", "dist3")
MR_SCHEMES = ("decen", "sub", "hiera")


def scheme_runs(spark, sf_dir):
    """The six partitioned filters of the Spark side of the study."""
    return _scheme_runs(spark, sf_dir, SPARK_SCHEMES, SPARK_SIDE)


def mr_scheme_runs(spark, sf_dir):
    """The partitioned filters of its MapReduce side."""
    return _scheme_runs(spark, sf_dir, MR_SCHEMES, MR_SIDE)


def online_run(spark, sf_dir):
    """The bootstrap filter fed by a file stream of events, one step per event of a user."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events*.parquet")
    # the step is part of the stream's record: the place among the user's events comes from the table
    records = stream.join(_placed(spark, sf_dir), "event_id").select("series_id", "t", (F.col("value") / 25.0).alias("y"))
    online = OnlineFilter(spark, config=CONFIG)
    query = online.start(records)
    query.awaitTermination()
    return _rounded(online.summaries())


def live_run(spark, sf_dir):
    """The same stream with the sets in keyed state, into a file sink."""
    session, path = live_session(spark), new_path(spark, "live")
    stream = session.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events*.parquet")
    records = stream.join(_placed(session, sf_dir), "event_id").select("series_id", "t", (F.col("value") / 25.0).alias("y"))
    said = live_filter(records, config=CONFIG)
    said.writeStream.option("checkpointLocation", f"{path}/commits").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    return _rounded(spark.read.schema(said.schema).parquet(f"{path}/out"))


def _placed(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("series_id"), F.row_number().over(order).alias("t"))


QUERIES = {
    "scheme_comparison": (scheme_comparison, None),
    "bootstrap_run": (bootstrap_run, bootstrap_sql(CONFIG)),
    "stored_ess": (stored_ess, stored_ess_sql(CONFIG, STORED_STEP)),
    "stored_integral": (stored_integral, stored_integral_sql(CONFIG, STORED_STEP)),
    "stored_ancestors": (stored_ancestors, stored_ancestors_sql(CONFIG, STORED_STEP, BACK_TO)),
    "apf_run": (apf_run, auxiliary_sql(CONFIG)),
    "guided_run": (guided_run, guided_sql(CONFIG)),
    "imm_prior": (imm_prior, imm_prior_sql(CONFIG)),
    "aux_imm_run": (aux_imm_run, imm_sql(CONFIG)),
    "scheme_runs": (scheme_runs, schemes_sql(SPARK_SIDE, SPARK_SCHEMES)),
    "mr_scheme_runs": (mr_scheme_runs, schemes_sql(MR_SIDE, MR_SCHEMES)),
    "online_run": (online_run, bootstrap_sql(CONFIG)),
    "live_run": (live_run, bootstrap_sql(CONFIG)),
}
