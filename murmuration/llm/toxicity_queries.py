"""Registered query of the toxicity operator (9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .toxicity import toxicity


def op9_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op9_nnpu_toxicity,)}
ORACLES: dict[str, str] = {}
