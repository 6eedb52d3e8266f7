"""Registered queries of the token operators (2, 3 and 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import new_path, read
from .packing import Capacities, pack
from .token_counts import token_counts
from .token_files import read_token_files, write_token_files

CONTEXT = 2048
#: Pieces of one packed sequence.
DOCUMENTS = 256


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents"), vocabulary(), CONTEXT)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_token_files(read(spark, sf_dir, "documents"), path, vocabulary(), end_id=1)
    return read_token_files(spark, path)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), vocabulary(), end_id=0, caps=Capacities(tokens=CONTEXT, documents=DOCUMENTS, attention=CONTEXT * CONTEXT))


QUERIES = {f.__name__: f for f in (op2_token_counts, op3_token_files, op4_best_fit_packing)}
ORACLES: dict[str, str] = {}
