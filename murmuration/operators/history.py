"""Sets of earlier steps: a table by step, with each particle's parent.

A run that is given a folder leaves its weighted set of every step there, as
it was before resampling, one partition a step. Statistics of any step read
that partition alone, and a path back through the parents is a join a step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut
from .resample import ONE, fixed
from .stats import effective_size, weighted_mean

def schema_of(series_type: str) -> str:
    """Columns of a stored step; ``parent`` is the particle of the step before from which one comes."""
    return f"series_id {series_type}, id long, parent long, w long, x double"


class History:
    """The stored sets of one run at ``path``; ``keys`` name what tells its series apart.

    A set has fixed-point weights ``w`` or log-weights ``lw``. A step that is
    not there has no rows; weights that all vanish count as equal.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...] = ("series_id",)):
        self.spark, self.path, self.schema, self.keys = spark, path, schema, list(keys)

    def write(self, rows: DataFrame, t: int) -> None:
        """Store step t; a step that is written again replaces what was there."""
        rows.write.mode("overwrite").parquet(f"{self.path}/t={t}")

    def append(self, rows: DataFrame) -> None:
        """Store the steps of ``rows``, which have ``t``."""
        rows.write.mode("append").partitionBy("t").parquet(self.path)

    def raw(self, t: int) -> DataFrame:
        """Step t as it was stored."""
        return self.steps().where(F.col("t") == t).drop("t")

    def steps(self) -> DataFrame:
        """All steps with their number ``t``, which prunes what is read."""
        return self.spark.read.schema(f"{self.schema}, t int").option("basePath", self.path).parquet(self.path)

    def weighted(self, t: int | None = None) -> DataFrame:
        """The sets of step t, or of all steps, with fixed-point weights ``w`` from their log-weights."""
        rows = self.steps() if t is None else self.steps().where(F.col("t") == t)
        return weights_of(rows, [*self.keys, "t"]) if "lw" in rows.columns else rows

    def effective_size(self, t: int) -> DataFrame:
        """``keys, t, ess`` of a step."""
        return self.weighted(t).groupBy(*self.keys, "t").agg(effective_size().alias("ess"))

    def integral(self, f: Column, t: int) -> DataFrame:
        """``keys, t, value``: the weighted mean of f over a step's set."""
        return self.weighted(t).withColumn("__f", f).groupBy(*self.keys, "t").agg(weighted_mean("__f").alias("value"))

    def ancestors(self, t: int, back_to: int) -> DataFrame:
        """``keys, id, t, ancestor, x``: for each particle of step t its ancestor at every step from ``back_to``.

        Parents are joined a step at a time and each step's partition is read
        once.
        """
        lines = self.raw(t).select(*self.keys, "id", F.col("id").alias("ancestor"))
        out = []
        for step in range(t, back_to - 1, -1):
            here = self.raw(step).select(*self.keys, F.col("id").alias("ancestor"), "parent", "x")
            met = cut(lines.join(here, [*self.keys, "ancestor"]))
            out.append(met.select(*self.keys, "id", F.lit(step).alias("t"), "ancestor", "x"))
            lines = met.select(*self.keys, "id", F.col("parent").alias("ancestor"))
        joined = out[0]
        for rows in out[1:]:
            joined = joined.unionByName(rows)
        return joined


def weights_of(rows: DataFrame, keys: list[str], lw: str = "lw") -> DataFrame:
    """``rows`` with fixed-point weights ``w``, shifted by the largest log-weight of each key; equal ones where all vanish."""
    top = rows.groupBy(*keys).agg(F.max(lw).alias("__top"))
    joined = rows.join(top, keys) if keys else rows.crossJoin(F.broadcast(top))  # one row
    w = F.when(F.col("__top").isNull(), F.lit(ONE)).otherwise(F.coalesce(fixed(F.exp(F.col(lw) - F.col("__top"))), F.lit(0)))
    return joined.withColumn("w", w.cast("long")).drop("__top")
