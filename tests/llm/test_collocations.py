"""Collocations against plain counting, and the scans' own rules."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from murmuration.llm.collocation_queries import ORACLES, QUERIES
from murmuration.llm.collocations import NEVER, Mining, collocations, counted, frequent_phrases

from ..conftest import same_rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, threshold, top):
    """The definition, over (lang, text)."""
    f, total = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i : i + k])] += 1
    enough = {p: a for p, a in f.items() if a >= threshold and len(p[1]) > 1}
    held = {}
    for (lang, words), a in enough.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                sub = (lang, words[i : i + k])
                held[sub] = max(held.get(sub, 0), a)
    out = []
    for (lang, words), a in enough.items():
        if held.get((lang, words), 0) >= a:
            continue
        cuts = [(1000 * a * total[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], total[lang]))
    ranked, seen = [], Counter()
    for lang, score, a, phrase, left, right, n in sorted(out):
        seen[lang] += 1
        if seen[lang] <= top:
            ranked.append((lang, seen[lang], phrase.decode(), -a, left, right, n, -score))
    return ranked


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, n):
    r = random.Random(seed)
    words = ["Alpha", "beta", "gamma", "de-lta", "é", "ñu", "x", "日本", "q\x0bq", "it's"]
    text = lambda: "".join(r.choice([*words, "one two three", "one two three four five six"]) + r.choice([" ", " ", " ", "\t", " . ", ",", "\n", "  "]) for _ in range(r.randrange(30)))
    return [(r.choice(["en", "en", "en", "de", None]), text()) for _ in range(n)]


@pytest.mark.parametrize("shards", [1, 3])
def test_counts_are_exact(spark, shards):
    rows = [*corpus(1, 400), ("en", None), ("en", ""), ("en", " \t\n"), (None, None), *[("en", "same words here and there. " * 3)] * 40, ("de", "long text of words " * 3000), ("fr", "a a a a a a a a")]
    docs = spark.createDataFrame([(i, lang, text, 0, 0, 0) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, n int, phrase int, shard int").repartition(5)
    for mining in (Mining(threshold=4, shards=shards, chunk_words=50, row_words=7, slice_bytes=300), Mining(threshold=4, shards=shards, slot_bits=2), Mining(threshold=9, shards=shards)):
        assert rows_of(collocations(docs, 30, mining)) == sorted(brute(rows, mining.threshold, 30))


def test_empty_and_null(spark):
    empty = spark.createDataFrame([], "doc_id long, lang string, text string")
    assert collocations(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (2, None, "")], "doc_id long, lang string, text string")
    assert collocations(nulls).count() == 0


def test_a_phrase_is_counted_for_one_cycle():
    mining = Mining(threshold=2, shards=3, slot_bits=16)
    words = np.array([5, 6, 7, 0, 5, 6], np.uint64)
    table = np.full(1 << 16, NEVER, np.uint8)
    seen = lambda scan: {tuple(p): (int(n), int(s)) for phrases, counts, starts in counted("en", words, table, scan, mining) for p, n, s in zip(phrases.tolist(), counts, starts, strict=True)}
    assert seen(0) == {(5,): (2, 0), (6,): (2, 0), (7,): (1, 0)}
    from murmuration.llm.collocations import _slots

    table[_slots("en", np.array([[5]], np.uint64), 16)] = 0
    table[_slots("en", np.array([[6]], np.uint64), 16)] = 1
    assert seen(2)[5, 6] == (2, 2)  # joins after the later of its words
    assert (6, 7) not in seen(2)
    assert seen(4) == {(5, 6): (2, 2)}
    assert seen(5) == {}
    table[_slots("fr", np.array([[7]], np.uint64), 16)] = 1
    assert (6, 7) not in seen(4)  # another language's words are others


def test_op11_agrees_with_sql(spark):
    folder = "/root/testdata/sf0.01"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    found = QUERIES["op11_collocations"](spark, folder).toPandas()
    assert len(found) > 50
    same_rows(found, connection.execute(ORACLES["op11_collocations"]).df())


def test_scans_end_one_cycle_after_the_last_reached(spark):
    docs = spark.createDataFrame([("en", "a b c d e f. ")] * 60, "lang string, text string").repartition(3)
    found, totals, _ = frequent_phrases(docs, Mining(threshold=50, shards=2))
    assert {len(r["phrase"]) // 8 for r in found.collect()} == {1, 2, 3, 4, 5}
    assert {r["n"] for r in found.collect()} == {60}
    assert totals.collect()[0]["n"] == 360


def test_a_phrase_joins_after_what_it_holds():
    """Another phrase marked the slot of (5, 6, 7) long before (5, 6) reached the threshold."""
    from murmuration.llm.collocations import _slots

    mining = Mining(threshold=1, shards=3, slot_bits=16)
    words = np.array([5, 6, 7, 8], np.uint64)
    table = np.full(1 << 16, NEVER, np.uint8)
    for phrase, scan in [((5,), 0), ((6,), 0), ((7,), 0), ((8,), 0), ((5, 6), 4), ((6, 7), 1), ((7, 8), 1), ((6, 7, 8), 2), ((5, 6, 7), 0)]:
        slot = _slots("en", np.array([phrase], np.uint64), 16)
        assert table[slot] == NEVER
        table[slot] = scan
    starts = {scan: s for scan in range(5, 11) for phrases, _, starts in counted("en", words, table, scan, mining) for p, s in zip(phrases.tolist(), starts, strict=True) if p == [5, 6, 7, 8]}
    assert starts == {6: 6, 7: 6, 8: 6}


@pytest.mark.parametrize(("seed", "slot_bits"), [(11, 7), (40, 6)])
def test_phrases_that_share_slots_are_not_lost(spark, seed, slot_bits):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    rows = [("en", " ".join(words[min(int(r.expovariate(0.4)), 39)] for _ in range(r.randrange(1, 12)))) for _ in range(300)]
    docs = spark.createDataFrame(rows, "lang string, text string").coalesce(1)
    assert rows_of(collocations(docs, 10_000, Mining(threshold=4, slot_bits=slot_bits, row_words=20))) == sorted(brute(rows, 4, 10_000))
