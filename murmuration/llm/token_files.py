"""Token-ID output: Simple-8b segments in doc_id order, and their reader."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simple8b
from .common import shuffle_partitions, texts_of
from .unit_tokens import cuts_at_units, unit_tokenizer


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, ranges: int | None = None, segment_ids: int = 1 << 20) -> None:
    """Encode every text, append ``end_id``, and write segments at ``path``.

    Rows are dealt by ranges of doc_id (ties by text hash and row, so a doc_id
    of many rows is split too) and sorted within; ``range_id, segment`` is
    then the global order. A segment closes once it has ``segment_ids`` ids; a
    document never spans two. Spark commits the files, so a lost executor's
    tasks run again without leaving halves.

    Null and empty texts hold the end id alone. Null doc_ids come first, and
    repeated rows stay apart. An empty table gives no segments.
    """
    if not cuts_at_units(tokenizer):
        raise ValueError("the token writer needs a tokenizer that does not merge across white space")
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        units, range_id = unit_tokenizer(tokenizer), TaskContext.get().partitionId()
        names: list = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        before = segment = size = 0

        def row():
            words, first, escapes = simple8b.encode(np.concatenate(held))
            return pa.RecordBatch.from_pydict(
                {
                    "range_id": pa.array([range_id], pa.int32()),
                    "segment": pa.array([segment], pa.int32()),
                    "ids_before": pa.array([before], pa.int64()),
                    "n_ids": pa.array([size], pa.int64()),
                    "doc_ids": pa.ListArray.from_arrays([0, sum(map(len, names))], pa.concat_arrays(names)),
                    "lengths": pa.array([np.concatenate(lengths).astype("<u4").tobytes()], pa.binary()),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    "block_words": pa.array([first.astype("<u4").tobytes()], pa.binary()),
                    "escapes": pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
                }
            )

        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for a, ids, at in units.encode(data, offsets):
                n = len(at) - 1
                ended = np.insert(ids, at[1:], np.uint32(end_id))
                held.append(ended)
                lengths.append(np.diff(at) + 1)
                names.append(batch.column(0).slice(a, n))
                size += len(ended)
                if size >= segment_ids:
                    yield row()
                    before, segment, size = before + size, segment + 1, 0
                    names, held, lengths = [], [], []
        if size:
            yield row()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ordered = keyed.repartitionByRange(ranges or shuffle_partitions(spark), "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")
    ordered.select("doc_id", "text").mapInArrow(
        run,
        f"range_id int, segment int, ids_before long, n_ids long, doc_ids array<{kind}>, lengths binary, words binary, block_words binary, escapes binary",
    ).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` decoded from the segments at ``path``.

    ``start`` counts the ids of all documents before. The ids before a range
    are a running sum over one number per range, which is all the driver sees.
    """
    segments = spark.read.parquet(path)
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    total, base = 0, {}
    for r in segments.groupBy("range_id").agg(F.sum("n_ids").alias("n")).orderBy("range_id").collect():
        base[r["range_id"]] = total
        total += r["n"]

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda name, i=i, batch=batch: batch.column(name)[i].as_py()
                as_array = lambda name, kind: np.frombuffer(get(name), kind)  # noqa: E731, B023
                ids = simple8b.decode(as_array("words", "<u8"), as_array("block_words", "<u4").astype(np.int64), as_array("escapes", "<u8"), get("n_ids")).astype("<u4")
                lengths = as_array("lengths", "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                sums = [zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                start = base[get("range_id")] + get("ids_before") + ends - lengths
                doc_ids = batch.column("doc_ids").slice(i, 1).flatten()
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(start), pa.array(lengths), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")
