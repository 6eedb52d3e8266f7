"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``.

    A session on one machine that names none gets a temporary folder; on a
    cluster that would be each machine's own, so there it is an error.
    """
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="murmuration-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: columns apart, lineage cut."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, keyed: DataFrame, keys: list[str], hot: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with ``keyed``, which has a row for each key and ``n``, how many of ``rows`` have it.

    Keys that hold more than one in ``hot`` of all rows are ``hot`` at most, so
    their side is broadcast; only the others, none of them large, are shuffled.
    """
    total = keyed.agg(F.sum("n")).first()[0] or 0
    limit = max(10_000, total // hot)
    large = keyed.where(F.col("n") > limit)
    small = rows.join(keyed.where(F.col("n") <= limit), keys)
    if not large.limit(1).count():
        return small
    few = F.broadcast(large)
    rest = rows.join(F.broadcast(large.select(*keys)), keys, "left_anti").join(keyed.where(F.col("n") <= limit), keys)
    return rows.join(few, keys).unionByName(rest)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, though ``body`` uses it in a function of array elements."""
    return F.get(F.transform(F.array(value), body), 0)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def slices_by_bytes(offsets: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text has a range to itself."""
    out, first, n = [], 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(first + 1, last))
        out.append((first, last))
        first = last
    return out


def utf8_bytes(column: str):
    """UTF-8 length of a text column as a long, null as 0."""
    return F.coalesce(F.octet_length(F.col(column)), F.lit(0)).cast("long")
