"""Counts, files and packing against the library on whole texts."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from murmuration.llm import simple8b
from murmuration.llm.packing import Capacities, best_fit, pack
from murmuration.llm.token_counts import token_counts
from murmuration.llm.token_files import read_token_files, write_token_files
from murmuration.llm.token_queries import QUERIES, vocabulary
from murmuration.llm.unit_tokens import UnitTokenizer, cuts_at_units

from ..conftest import SMALL


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def documents(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abzAZ019 \n\t.,'<|>-_é́ÉÀ×ßİΣς 　½²\U0001f600")) | st.characters(codec="utf-8"), max_size=40), max_size=6))
def test_units_are_the_library(texts):
    from tokenizers import Tokenizer

    import pyarrow as pa

    from murmuration.llm.common import texts_of

    library = Tokenizer.from_file(vocabulary())
    data, offsets = texts_of(pa.array([*texts, "<|endoftext|>x", None], pa.string()))
    units = UnitTokenizer(vocabulary(), max_units=5, slice_bytes=16)
    wanted = [ids_of(library, t) for t in [*texts, "<|endoftext|>x", None]]
    assert units.counts(data, offsets).tolist() == [len(w) for w in wanted]
    found = {a + i: ids[at[i] : at[i + 1]].tolist() for a, ids, at in units.encode(data, offsets) for i in range(len(at) - 1)}
    assert [found.get(i, []) for i in range(len(wanted))] == wanted


def test_op2(spark, library):
    texts = documents(spark)
    rows = QUERIES["op2_token_counts"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(ids_of(library, texts[r["doc_id"]]))
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len((texts[r["doc_id"]] or "").encode()), n, n > 2048)


def test_other_tokenizers(spark, messy):
    import public_tokenizers

    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        assert not cuts_at_units(path)
        rows = token_counts(messy.where("doc_id < 8"), path).collect()
        assert len(rows) == 8 and all((r["n_tokens"] == 0) == (r["n_bytes"] == 0) for r in rows if r["doc_id"] != 4)


def test_op3(spark, library):
    texts = documents(spark)
    rows = {r["doc_id"]: r for r in QUERIES["op3_token_files"](spark, SMALL).collect()}
    start = 0
    for doc_id in sorted(texts):
        ids = [*ids_of(library, texts[doc_id]), 1]
        r = rows[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op4(spark, library):
    texts = documents(spark)
    check_packing(QUERIES["op4_best_fit_packing"](spark, SMALL).collect(), [(d, ids_of(library, t)) for d, t in texts.items()], 2048, 1.01)


def check_packing(rows, documents, limit, waste):
    pieces = {}
    for doc_id, ids in documents:
        whole = [*ids, 0]
        for k in range(0, len(whole), limit):
            part = whole[k : k + limit]
            pieces.setdefault((doc_id, k // limit, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())), 0)
            pieces[doc_id, k // limit, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    found = {}
    for r in rows:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        found[key] = found.get(key, 0) + 1
    assert found == pieces
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(r["length"] for r in rows)
    assert len(sequences) <= max(1, -(-total // limit)) * waste + 1


def test_messy_and_empty(spark, messy, nothing, library, tmp_path):
    counts = sorted((str(r["doc_id"]), r["n_tokens"]) for r in token_counts(messy, vocabulary()).collect())
    wanted = sorted((str(r["doc_id"]), len(ids_of(library, r["text"]))) for r in messy.select("doc_id", "text").collect())
    assert counts == wanted
    write_token_files(messy, str(tmp_path / "files"), vocabulary(), 1, ranges=3, segment_ids=500)
    rows = read_token_files(spark, str(tmp_path / "files")).collect()
    assert sum(r["n_tokens"] for r in rows) == sum(n + 1 for _, n in wanted)
    ordered = sorted(rows, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered] == sorted((r["doc_id"] for r in rows), key=lambda d: (d is not None, d))
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(ordered, ordered[1:]))
    packed = pack(messy, vocabulary(), 0).collect()
    check_packing(packed, [(r["doc_id"], ids_of(library, r["text"])) for r in messy.collect()], 2048, 1.05)
    assert token_counts(nothing, vocabulary()).count() == 0
    assert pack(nothing, vocabulary(), 0).count() == 0
    write_token_files(nothing, str(tmp_path / "none"), vocabulary(), 1)
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_000), st.integers(0, 2**64 - 1)), max_size=3000))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    words, first, escapes = simple8b.encode(v)
    assert (simple8b.decode(words, first, escapes, len(v)) == v).all()
    for b in range(len(first)):
        assert (simple8b.decode_block(words, first, escapes, len(v), b) == v[b * simple8b.BLOCK : (b + 1) * simple8b.BLOCK]).all()
    assert (v >= 2**60).sum() == len(escapes)


@pytest.mark.parametrize("caps", [Capacities(100, 3, 10**9), Capacities(100, 99, 5000), Capacities(100, 4, 6000, rule="dot")])
def test_best_fit_meets_every_capacity(caps):
    r = random.Random(4)
    lengths = np.array([r.randrange(1, 60) for _ in range(300)])
    bins, offsets = best_fit(lengths, caps)
    for b in set(bins.tolist()):
        mine = np.flatnonzero(bins == b)
        assert lengths[mine].sum() <= caps.tokens and len(mine) <= caps.documents and (lengths[mine] ** 2).sum() <= caps.attention
        ends = np.sort(offsets[mine] + lengths[mine])
        assert set(offsets[mine]) == {0, *ends[:-1]}
    with pytest.raises(ValueError):
        best_fit(np.array([caps.tokens + 1]), caps)
