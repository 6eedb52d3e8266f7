"""Token counts: lengths only, from batches balanced by bytes."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_by_bytes, texts_of
from .unit_tokens import cuts_at_units, unit_tokenizer

_KEPT: dict[str, object] = {}


def _library_counter(path: str, slice_bytes: int):
    """Counts by whole texts, for files whose tokens may cross white space."""
    if path not in _KEPT:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _KEPT[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            _KEPT[path] = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    count = _KEPT[path]

    def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, b in slices_by_bytes(offsets, slice_bytes):
            out[a:b] = count([data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8") for i in range(a, b)])
        return out

    return counts


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    One narrow pass: no shuffle, and no text leaves the executor's Python
    worker; only lengths come back. Batches are balanced by bytes
    (``slice_bytes``). Where the tokenizer never merges across white space,
    texts longer than that are cut at white space and their counts summed;
    other tokenizers have no boundary that is always safe, so each of their
    texts is encoded whole.

    Null and empty texts have 0 bytes and 0 tokens. A null id stays null,
    repeated rows each give a row, an empty table gives none, and columns
    other than the two named are not read.
    """
    kind = docs.schema[id_col].dataType
    by_units = cuts_at_units(tokenizer)

    def run(batches):
        counts = unit_tokenizer(tokenizer).counts if by_units else _library_counter(tokenizer, slice_bytes)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            n = counts(data, offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
