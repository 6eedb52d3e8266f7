"""Corpus cleaning as a chain of training-data operators.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but
the last return the columns of documents. ``run`` writes each stage's result
as Parquet in the shared folder and reads it back as the next one's input, so
a lost executor costs a stage at most. Nulls, repeated rows, empty tables and
further columns are handled as each stage's operator says; no row is special
here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmuration.llm.common import new_path, read
from murmuration.llm.decontaminate import decontaminate
from murmuration.llm.line_dedup import dedup_lines
from murmuration.llm.lsh_forest import keep_one
from murmuration.llm.packing import Capacities, pack
from murmuration.llm.token_queries import CONTEXT, DOCUMENTS, vocabulary
from murmuration.llm.toxicity import THRESHOLD, scores, train

#: Score from which a document is rejected: the operator's own.
REJECT = THRESHOLD


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, lengthened until no column has it."""
    while name.lower() in map(str.lower, docs.columns):
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose whole text scores under ``REJECT``; null and empty texts score as the prior."""
    model = train(docs, read(spark, sf_dir, "labels"))
    name = free_name(docs, "score")
    return scores(docs, model, name).where(F.col(name) < REJECT).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows that still have text, without later copies of repeated passages.

    n_chars follows the text. A row that loses its last word stood in earlier
    documents as a whole and goes; null and empty texts stay as they are.
    """
    removed = free_name(docs, "n_removed")
    # asked inside the row: as a filter it would be moved below what it reads, which then were computed again
    row = F.array(F.struct(*docs.columns, removed))
    keeps = lambda r: (r[removed] == 0) | r["text"].rlike(r"[^\x20\x09-\x0D]")
    out = dedup_lines(docs, removed=removed).select(F.inline(F.filter(row, keeps))).select(*docs.columns)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: five-word shingles, similarity 0.8. Rows without words all stay."""
    return keep_one(docs, width=5, threshold=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item; null and empty texts hold none."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows, packed into sequences."""
    return pack(docs, vocabulary(), end_id=0, caps=Capacities(tokens=CONTEXT, documents=DOCUMENTS, attention=CONTEXT * CONTEXT))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Classifier, MinHash and tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of ``documents`` after all stages, from all its rows.

    Null, empty and very long texts, repeated rows and ties are what each
    stage's operator says; an empty table gives no pieces. Extra columns,
    whatever their names, go through up to packing.
    """
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
