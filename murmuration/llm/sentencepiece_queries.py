"""Registered query of SentencePiece encoding and decoding (13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .sentencepiece_spans import encode_spans


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_sentencepiece_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_spans(read(spark, sf_dir, "documents"), piece_model())
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "n_spanned")


QUERIES = {f.__name__: f for f in (op13_sentencepiece_spans,)}
ORACLES: dict[str, str] = {}
