"""Registered query of the sharding operator (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import new_path, read
from .sharding import shard


def op7_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(read(spark, sf_dir, "documents"), 8, new_path(spark, "slot-map"))


QUERIES = {f.__name__: f for f in (op7_virtual_slots,)}
ORACLES: dict[str, str] = {}
