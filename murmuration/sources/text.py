"""Text and Parquet forms of observations and particles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with their 1-based place in the file, in two levels: no task counts the whole file."""
    placed = lines.select("value", F.monotonically_increasing_id().alias("__m"))
    part, within = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    split = placed.select("value", part.alias("__p"), within.alias("__k"))
    sizes = split.groupBy("__p").agg(F.count("*").alias("__n"))
    bases = sizes.select("__p", (F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__base"))
    return split.join(bases, "__p").select((F.col("__base") + F.col("__k") + 1).alias("n"), "value")


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """``t, y`` from a file of one number per line; blanks around it don't matter."""
    return _numbered(spark.read.text(path)).select(F.col("n").cast("int").alias("t"), F.trim("value").cast("double").alias("y"))


def observation(observations: DataFrame, step: int) -> DataFrame:
    """The step-th observation; a filter that reaches the scan. A step past the end is an error to the caller that reads it."""
    return observations.where(F.col("t") == step)


def read_particles(spark: SparkSession, path: str, order: str = "state weight", parts: int = 1) -> DataFrame:
    """``id, part, w, x`` from lines of two numbers, whose ``order`` differs between writers.

    Sub-filters are equal stretches of the file; the first take one row more
    where the rows don't divide.
    """
    fields = F.split(F.trim("value"), r"\s+")
    first, second = (F.get(fields, k).cast("double") for k in (0, 1))
    x, w = (first, second) if order == "state weight" else (second, first)
    rows = _numbered(spark.read.text(path)).select((F.col("n") - 1).alias("id"), w.alias("w"), x.alias("x"))
    size = rows.count()
    part = F.least(F.floor(F.col("id") * parts / max(1, size)), F.lit(parts - 1)).cast("int")
    return rows.select("id", part.alias("part"), "w", "x")


def write_particles(df: DataFrame, path: str, order: str = "weight state", w: str = "w", x: str = "x") -> None:
    first, second = (w, x) if order == "weight state" else (x, w)
    df.select(F.concat_ws(" ", F.col(first).cast("string"), F.col(second).cast("string"))).write.text(path)


def write_numbers(df: DataFrame, path: str, column: str) -> None:
    """One number per line."""
    df.select(F.col(column).cast("string")).write.text(path)


def write_step(df: DataFrame, path: str, t: int) -> None:
    """A filter's set after step t, beside those of other steps."""
    df.withColumn("t", F.lit(t)).write.mode("append").partitionBy("t").parquet(path)


def read_step(spark: SparkSession, path: str, t: int) -> DataFrame:
    """The set after step t: one folder is read."""
    return spark.read.parquet(path).where(F.col("t") == t)
