"""A store of observations by ranges of steps, from which a step is read without the others.

Rows are range-partitioned by step and series, so files are equally large
however the steps are spread and each holds a narrow range of steps. A folder
holds ``width`` steps: a reader prunes folders by the partition columns, and
row groups by their least and largest t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _first(t: Column, width: Column) -> Column:
    """The first step of the folder that holds t."""
    return t - F.pmod(t, width)


def write_observations(observations: DataFrame, path: str, width: int = 1000, files: int | None = None, mode: str = "append") -> None:
    """Store ``observations(t, ...)``, further columns included.

    Rows without t belong to no step and are left out. Stores may be appended
    to, with another width as well. ``files`` is the number of write tasks
    (None: the session's shuffle partitions); one writes a file for each
    folder that its range meets. Columns named ``width`` or ``span`` are an
    error, as folders are named by them.
    """
    taken = {"width", "span"} & {c.lower() for c in observations.columns}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are names of folders")
    if width < 1:
        raise ValueError("a folder holds a step at least")
    rows = observations.where("t is not null").withColumn("t", F.col("t").cast("int"))
    keys = ["t", *(["series_id"] if "series_id" in observations.columns else [])]
    ranged = rows.repartitionByRange(*([files] if files else []), *keys)
    named = ranged.withColumn("width", F.lit(width)).withColumn("span", _first(F.col("t"), F.lit(width)))
    named.sortWithinPartitions(*keys).write.mode(mode).partitionBy("width", "span").parquet(path)


def read_steps(spark: SparkSession, path: str, low: int, high: int | None = None, schema: str | StructType | None = None) -> DataFrame:
    """The observations of the steps ``low..high`` (``high`` None: of step ``low``); no rows where there are none.

    With the ``schema`` of what was stored no footer of another folder is opened, either.
    """
    high = low if high is None else high
    width, span = F.col("width"), F.col("span")
    near = (span <= high) & (span >= _first(F.lit(low), width))
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path).where(near & F.col("t").between(low, high)).drop("width", "span")
