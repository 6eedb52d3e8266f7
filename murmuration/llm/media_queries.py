"""Registered query of the media operator (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import new_path, read
from .media import media_features, store_media


def op10_baseline_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "media")
    store_media(read(spark, sf_dir, "documents"), path)
    return media_features(spark.read.parquet(path))


QUERIES = {f.__name__: f for f in (op10_baseline_jpeg,)}
ORACLES: dict[str, str] = {}
