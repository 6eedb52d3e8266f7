"""Particle sets and observation series from warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rng import lcg
from ..operators.models import BenchmarkModel
from ..operators.resample import fixed


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_particles(spark: SparkSession, sf_dir: str, parts: int = 4) -> DataFrame:
    """``id, part, x``: one particle per event."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % parts).cast("int").alias("part"), (F.col("value") / 25.0 - 10.0).alias("x"))


def weighted_events(spark: SparkSession, sf_dir: str, y: float, t: float, model: BenchmarkModel | None = None) -> DataFrame:
    """``id, part, x, w``: event particles moved with scripted noise and weighed after the move."""
    model = model or BenchmarkModel()
    moved = event_particles(spark, sf_dir).select("id", "part", model.propagate(F.col("x"), F.lit(t), 2 * lcg("id") - 1).alias("x"))
    return moved.withColumn("w", fixed(model.likelihood(y, F.col("x"))))


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``series_id, t, y``: all values of each user, in order of time."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ranked = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").withColumn("t", F.row_number().over(order))
    return ranked.select(F.col("user_id").alias("series_id"), "t", (F.col("value") / 25.0).alias("y"))
