"""The chain of stages: each one's decisions, columns, and odd rows."""

import corpus_pipeline
from murmuration.llm.toxicity import THRESHOLD, toxicity

from ..conftest import SMALL
from .test_dedup import brute, plain_dedup


def test_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, SMALL)
        assert out.columns == columns
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert after.keys() <= before.keys() and len(after) > 0.7 * len(before)
        if name == "line_dedup":
            left = plain_dedup(list(before.items()))
            assert after == {k: t for k, t in left.items() if t == before[k] or t.strip()}  # rows that lose all their text go
            assert len(after) < len(before)
        else:
            assert all(after[k] == before[k] for k in after)
        if name == "near_dedup":
            groups = brute([(k, t) for k, t in before.items()], 5)
            assert after.keys() == {k for k, (c, n) in groups.items() if c == k or n == 0}
        docs = out.cache()


def test_messy_rows_go_through(spark, messy, nothing):
    for docs in (messy, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            if name != "packing":
                assert out.columns == messy.columns
            out.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and "sequence_id" in out.columns


def test_planted_rows_are_traced_through_the_filters(spark):
    """Copies, near copies, a leaked item, repeated rows and clean texts, followed through line dedup, near-dedup and decontamination."""
    item = spark.read.parquet(f"{SMALL}/benchmark.parquet").orderBy("item_id").first()["text"]
    base = " ".join(f"river{i} stone{i % 7}, and the old mill {i} turned." for i in range(40))
    clean = {100 + i: " ".join(f"topic{i} sentence{k} speaks of matter{i * 31 + k}." for k in range(30)) for i in range(5)}
    near = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base), (2, base), (1, base), (3, "intro words here. " + base), (4, near), (5, near.replace("w77 ", "changed ")), (6, f"Before it all. {item} And after it."), *clean.items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: sorted((r["doc_id"], r["text"]) for r in df.collect())
    lines = stages["line_dedup"](spark, docs, SMALL).cache()
    found = texts(lines)
    assert [t for i, t in found if i == 1] == [base, base]  # equal rows are one document
    assert not [t for i, t in found if i == 2]  # an exact copy of another goes as a whole
    assert [t for i, t in found if i == 3] == ["intro words here. "]
    kept = stages["near_dedup"](spark, lines, SMALL).cache()
    ids = [i for i, _ in texts(kept)]
    assert ids.count(1) == 1 and 4 in ids and 5 not in ids
    last = {i for i, _ in texts(stages["decontamination"](spark, kept, SMALL))}
    assert 6 not in last and last == set(ids) - {6} and clean.keys() <= last


def test_no_toxic_document_stays(spark):
    """What the operator calls toxic does not go on, with documents of all scores."""
    rows = [(i, " ".join(["awful"] * (i % 10) + [f"word{i % 7}"] * (10 - i % 10))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scored = {r["doc_id"]: r["predicted"] for r in toxicity(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, SMALL).collect()}
    assert kept == {i for i, toxic in scored.items() if not toxic}
    assert corpus_pipeline.REJECT == THRESHOLD
