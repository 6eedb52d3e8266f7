"""Registered query of the personal-data operator (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .pii import personal_data


def op8_context_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op8_context_bootstrap,)}
ORACLES: dict[str, str] = {}
