"""Pieces, spans and decoded texts against the library on whole texts."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2

from murmuration.llm.common import texts_of
from murmuration.llm.sentencepiece_queries import QUERIES, piece_model
from murmuration.llm.sentencepiece_spans import CharMap, SpanEncoder, encode_spans

from ..conftest import SMALL

ODD = list("ab A.,\n\t <>▁é́½²ｶﾞ①㌔ﬁ 　 ¨ß日本\x00\U0001f600")
TEXTS = st.lists(st.text(alphabet=st.sampled_from(ODD) | st.characters(codec="utf-8"), max_size=30), max_size=5)


@pytest.fixture(scope="module")
def models(tmp_path_factory):
    """The model as it is, and with the library's largest character map, squeezed white space and no byte pieces."""
    base = sentencepiece_model_pb2.ModelProto()
    with open(piece_model(), "rb") as f:
        base.ParseFromString(f.read())
    rules = sentencepiece_model_pb2.NormalizerSpec()
    rules.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_normalizer_spec())
    paths = {"own": piece_model()}
    for name, squeeze, fallback in (("mapped", False, True), ("squeezed", True, True), ("unknown", True, False)):
        spec = sentencepiece_model_pb2.ModelProto()
        spec.CopyFrom(base)
        spec.normalizer_spec.precompiled_charsmap = rules.precompiled_charsmap
        spec.normalizer_spec.remove_extra_whitespaces = squeeze
        spec.trainer_spec.byte_fallback = fallback
        if not fallback:
            for p in spec.pieces:
                if p.type == p.BYTE:
                    p.type = p.NORMAL
        paths[name] = str(tmp_path_factory.mktemp("models") / f"{name}.model")
        with open(paths[name], "wb") as f:
            f.write(spec.SerializeToString())
    return {name: (SpanEncoder(path, max_units=4, slice_bytes=24), sentencepiece.SentencePieceProcessor(model_file=path)) for name, path in paths.items()}


def check(encoder, library, texts):
    data, offsets = texts_of(pa.array(texts, pa.string()))
    found = {}
    for a, at, ids, starts, ends in encoder.spans(data, offsets):
        for i in range(len(at) - 1):
            here = slice(at[i], at[i + 1])
            found[a + i] = (ids[here].tolist(), list(zip(starts[here].tolist(), ends[here].tolist(), strict=True)))
    for i, text in enumerate(texts):
        pieces = library.encode(text or "", return_type="proto").pieces
        assert found[i][0] == [p.id for p in pieces] == library.encode(text or ""), text
        assert found[i][1] == [(p.begin, p.end) for p in pieces], text


@pytest.mark.parametrize("name", ["own", "mapped", "squeezed", "unknown"])
def test_ids_and_spans_are_the_library(models, name):
    @settings(max_examples=150, deadline=None)
    @given(TEXTS)
    def run(texts):
        check(*models[name], [*texts, None, "", "  ", " a  b ", "ﬁ①  ㌔ x"])

    run()


def test_map_takes_the_longest_key(models):
    encoder = models["mapped"][0]
    text = "ｶﾞｶa".encode()  # a letter with its voice mark is a key of two characters
    data = np.frombuffer(text, np.uint8)
    length, value = encoder.normaliser.chars.longest(data, np.array([0, 6, 9]), np.array([10, 10, 10]))
    assert length.tolist() == [6, 3, 0]
    flat, sizes = encoder.normaliser.chars.replacement(value[:2])
    assert flat.tobytes().decode() == "ガカ"
    assert sizes.tolist() == [3, 3]
    none = CharMap(b"").longest(data, np.array([0]), np.array([10]))
    assert (none[0].tolist(), none[1].tolist()) == ([0], [-1])


def test_op13(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = QUERIES["op13_sentencepiece_spans"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        text = texts[r["doc_id"]]
        ids = library.encode(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids)))
        assert r["n_spanned"] == len(text.encode())


def test_op13_odd_rows(spark, messy, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    wanted = sorted((str(r["doc_id"]), library.encode(r["text"] or "")) for r in messy.select("doc_id", "text").collect())
    rows = encode_spans(messy, piece_model()).collect()
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in rows) == wanted
    assert all(r["decoded"] == library.decode(list(r["ids"])) for r in rows)
    assert encode_spans(nothing, piece_model()).count() == 0
