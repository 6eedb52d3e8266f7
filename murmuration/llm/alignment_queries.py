"""Registered query of cross-tokenizer alignment (12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .sentencepiece_queries import piece_model
from .token_alignment import align_tokens

#: Entries of the second vocabulary, from which pairs are numbered.
PIECES = 32_000


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(read(spark, sf_dir, "documents"), byte_vocabulary(), piece_model(), PIECES)


QUERIES = {f.__name__: f for f in (op12_token_alignment,)}
ORACLES: dict[str, str] = {}
