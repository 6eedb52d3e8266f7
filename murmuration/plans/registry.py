"""Registered queries of the engine and the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import kernels, resampling, running, simulating, splitting

_ALL = kernels.QUERIES | resampling.QUERIES | running.QUERIES | simulating.QUERIES | splitting.QUERIES


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: one weighted set resampled by every scheme."""
    return running.scheme_comparison(spark, sf_dir)


def queries() -> dict:
    return {name: f for name, (f, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
