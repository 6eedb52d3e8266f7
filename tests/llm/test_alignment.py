"""Alignment against both libraries on whole texts and a plain double loop."""

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from murmuration.llm.alignment_queries import PIECES, QUERIES, byte_vocabulary
from murmuration.llm.common import texts_of
from murmuration.llm.sentencepiece_queries import piece_model
from murmuration.llm.token_alignment import Aligner, align_tokens, coalesced, overlaps

from ..conftest import SMALL

ODD = list("abc .,'\n\t<|>▁éß日　 \u0085\x1c\x00\U0001f600") + ["'s", "  ", " the", "<|endoftext|>"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(byte_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_model())


def letters():
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown}
    for k, b in enumerate(sorted(set(range(256)) - set(shown))):
        table[chr(256 + k)] = b
    return table


LETTERS = letters()


def plain(both, text):
    """(A ids, B ids, group text, links as id pairs) by the definitions, or nothing."""
    a, b = both
    if not text:
        return [], [], "", []
    whole = (" " + text).encode()
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(LETTERS[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return [], [], "", []
    ends_a, ends_b = np.cumsum([*map(len, bytes_a)]).tolist(), np.cumsum([*map(len, bytes_b)]).tolist()
    groups, i, j = [], 0, 0
    after_a, after_b = ({e: k + 1 for k, e in enumerate(ends)} for ends in (ends_a, ends_b))
    for end in sorted(set(ends_a) & set(ends_b)):
        x, y = after_a[end], after_b[end]
        groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
        i, j = x, y
    spans = lambda names, ends: [(e - len(n), e) for n, e in zip(names, ends, strict=True)]
    spans_b, links, low = spans(bytes_b, ends_b), [], 0
    for i, (p, q) in enumerate(spans(bytes_a, ends_a)):
        while spans_b[low][1] <= p:
            low += 1
        j = low
        while j < len(spans_b) and spans_b[j][0] < q:
            links.append((ids_a[i], ids_b[j]))
            j += 1
    return ids_a, ids_b, ";".join(groups), links


@pytest.fixture(scope="module")
def small_aligner():
    return Aligner(byte_vocabulary(), piece_model(), max_units=3, slice_bytes=20)


def test_units_are_whole_texts(both, small_aligner):
    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(ODD) | st.characters(codec="utf-8"), max_size=12).map("".join), max_size=5))
    def run(texts):
        texts = [*texts, None, "", " ", "a　  b", "é  x é x", "a ▁ b"]
        data, offsets = texts_of(pa.array(texts, pa.string()))
        seen = 0
        for first, numbers, said, ends, codes, times in small_aligner.texts(data, offsets):
            for i in range(len(said)):
                ids_a, ids_b, groups, links = plain(both, texts[first + i])
                assert said[i].decode() == groups, repr(texts[first + i])
                assert numbers[i].tolist() == [len(ids_a), len(ids_b), groups.count("|"), len(links)]
                here = slice(ends[i], ends[i + 1])
                assert dict(zip(codes[here].tolist(), times[here].tolist(), strict=True)) == Counter(x * PIECES + y for x, y in links)
                seen += 1
        assert seen == len(texts)

    run()


def test_groups_and_overlaps():
    a, b = (np.array([0, 2, 5, 9]), np.array([2, 5, 9, 10])), (np.array([0, 3, 5]), np.array([3, 5, 10]))
    group_a, group_b = coalesced(*a, *b)
    assert group_a.tolist() == [0, 0, 1, 1]
    assert group_b.tolist() == [0, 0, 1]
    assert list(zip(*(x.tolist() for x in overlaps(*a, *b)), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 2), (3, 2)]


def brute(both, rows):
    found = [(i, plain(both, t)) for i, t in rows]
    counts = Counter(p for _, (_, _, _, links) in found for p in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return sorted(
        (str(i), len(a), len(b), groups.count("|"), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links), hashlib.sha256(groups.encode()).hexdigest() if groups else "")
        for i, (a, b, groups, links) in found
    )


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(frame):
    return sorted((str(r["doc_id"]), *(r[c] for c in COLUMNS)) for r in frame.collect())


def test_op12(spark, both):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(QUERIES["op12_token_alignment"](spark, SMALL)) == brute(both, texts)


def test_op12_odd_rows_and_rare_pairs(spark, both, messy, nothing):
    small = messy.where("length(text) < 5000 or text is null")
    wanted = brute(both, [(r["doc_id"], r["text"]) for r in small.select("doc_id", "text").collect()])
    for hot in (5, 1 << 16):  # most pairs through the join, then through the broadcast
        assert rows_of(align_tokens(small, byte_vocabulary(), piece_model(), PIECES, hot_pairs=hot)) == wanted
    assert align_tokens(messy, byte_vocabulary(), piece_model(), PIECES).count() == messy.count()
    assert align_tokens(nothing, byte_vocabulary(), piece_model(), PIECES).count() == 0
