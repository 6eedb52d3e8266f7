"""Near-dedup against all pairs; line dedup against SQL and a plain loop."""

import random
import re

import pytest

from murmuration.llm.dedup_queries import QUERIES
from murmuration.llm.graph import components
from murmuration.llm.line_dedup import dedup_lines
from murmuration.llm.line_queries import ORACLES
from murmuration.llm.line_queries import QUERIES as LINES
from murmuration.llm.lsh_forest import Forest, keep_one, near_duplicates, regions

from ..conftest import SMALL, same_rows
from .conftest import prose

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if len(words) < width:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width):
    """Component and set size of each (key, text)."""
    sets = {k: shingles(t, width) for k, t in rows}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: (find(k), len(sets[k])) for k in keys}


def test_op1(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    wanted = brute(rows, 2)
    found = QUERIES["op1_minhash_lsh_forest"](spark, SMALL).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r["component_id"], r["n_shingles"]) == wanted[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def edited(text, seed, changes):
    r, words = random.Random(seed), text.split(" ")
    for _ in range(changes):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("forest", [Forest(), Forest(region=8, verify_group=5, order_rows=200)])
def test_a_dense_group(spark, forest):
    """Many near copies with links at the threshold, in one region and over depths."""
    base = prose(100, 120)
    rows = [(i, edited(base, i, i % 9)) for i in range(60)] + [(100 + i, prose(200 + i, 80)) for i in range(20)] + [(300 + i, prose(200, 80)) for i in range(10)]
    wanted = brute(rows, 2)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2, 0.8, forest).collect()
    got = {r["doc_id"]: r["component_id"] for r in found}
    assert got == {k: c for k, (c, _) in wanted.items()}


def test_regions_take_small_runs_whole_and_cut_large_ones():
    import numpy as np

    keys = np.array([[0, 0, 0]] * 10 + [[0, 0, 1], [0, 1, 0], [1, 0, 0], [1, 0, 0]])
    assert sorted(regions(keys, 1, 50)) == [(0, 12), (12, 14)]
    cut = sorted(regions(keys, 1, 4))
    assert (12, 14) in cut and all(b - a <= 4 for a, b in cut)
    assert {i for a, b in cut for i in range(a, b)} >= set(range(10))


def test_messy_rows(spark, messy, nothing):
    found = near_duplicates(messy, 2, 0.8).collect()
    assert len(found) == messy.count()
    by = {}
    for r in found:
        by.setdefault(r["doc_id"], []).append(r)
    assert {by[k][0]["component_id"] for k in (0, 1, 9)} == {0}
    for k in (2, 3, 4):
        assert (by[k][0]["n_shingles"], by[k][0]["component_id"], by[k][0]["kept"]) == (0, k, True)
    assert by[5][0]["n_shingles"] == 1
    assert len(by[6]) == 2 and all(r["component_id"] == 6 for r in by[6])
    assert by[None][0]["component_id"] is None
    assert near_duplicates(nothing).count() == 0
    kept = keep_one(messy, 2, 0.8)
    assert kept.columns == messy.columns
    assert {tuple(r[2:]) for r in kept.collect()} == {tuple(r[2:]) for r in messy.collect()}  # no clashing column is touched
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["0", "2", "3", "4", "5", "6", "8", "10", "11", "None"])
    assert keep_one(nothing).count() == 0


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + k) for k in range(1, 40)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)] + [(5, 5)]
    parent = {n: n for e in edges for n in e}
    for _ in range(70):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    found = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found.get(n, n) == root for n, root in parent.items() if (n, n) not in edges or n in found)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_op5(spark, duck):
    same_rows(LINES["op5_line_windows"](spark, SMALL).toPandas(), duck.execute(ORACLES["op5_line_windows"]).df())


def lines_of(text):
    return [x for x in re.split(r"(?<=\n)|(?<=[.!?,;:][ \n\t\r])|(?<=[^ \n\t\r]{9}[ \n\t\r])", text)] if text else [""]


def plain_dedup(rows, lines=3, least=60):
    seen, gone = set(), {}
    for key, text in sorted(rows):
        parts, covered = lines_of(text), set()
        for i in range(len(parts) - lines + 1):
            name = tuple(x.rstrip(" \n\t\r") for x in parts[i : i + lines])
            if name in seen:
                covered.update(range(i, i + lines))
            seen.add(name)
        run = []
        for i in [*sorted(covered), None]:
            if run and i != run[-1] + 1:
                if sum(len(parts[k]) for k in run) >= least:
                    gone.setdefault(key, set()).update(run)
                run = []
            run.append(i)
    return {k: "".join(x for i, x in enumerate(lines_of(t)) if i not in gone.get(k, ())) for k, t in rows}


def windows_of(text, n=50):
    words = text.split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_planted_passages_of_short_lines_and_of_few_marks(spark):
    """Passages over 50 words, with a mark after each word or with none at all, go from all but the first document."""
    short = " ".join(f"w{i}," for i in range(60))
    plain = " ".join("longerword" + str(i) if i % 6 == 0 else f"w{i}" for i in range(60))
    rows = []
    for i in range(8):
        rows.append((i, prose(i, 40) + " " + (short if i % 2 else plain) + " " + prose(90 + i, 40)))
    clean = [(20 + i, prose(400 + i, 120)) for i in range(4)]
    out = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert out == plain_dedup(rows + clean)
    for i in range(2, 8):
        assert not windows_of(out[i]) & windows_of(out[i % 2])
    assert all(out[k] == t for k, t in clean)
    assert short in out[1] and plain in out[0]


def test_passages_inside_and_between_lines(spark):
    passage = "We met by the river at noon, all of us. The boats were late, as ever.\nNobody minded; the sun was out. A dog slept, then woke."
    rows = [(i, prose(i, 30) + (" " if i % 2 else "\n") + passage + " " + prose(50 + i, 30)) for i in range(6)] + [(9, "a. a. a. a. " * 20), (10, prose(77, 200))]
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["text"] for k, r in out.items()} == plain_dedup(rows)
    assert "boats were late" in out[0]["text"]
    assert all("boats were late" not in out[i]["text"] for i in range(1, 6))
    assert out[10]["n_removed"] == 0 and out[10]["text"] == rows[-1][1]


def test_messy_lines(messy, nothing):
    out = dedup_lines(messy)
    assert out.columns == [*messy.columns, "n_removed"]
    assert {tuple(r[2:-1]) for r in out.collect()} == {tuple(r[2:]) for r in messy.collect()}
    rows = {}
    for r in out.collect():
        rows.setdefault(r["doc_id"], []).append(r)
    assert rows[2][0]["text"] is None and rows[3][0]["text"] == "" and rows[2][0]["n_removed"] == 0
    assert rows[0][0]["n_removed"] == 0 and rows[1][0]["n_removed"] > 0
    whole = {r["text"] for r in messy.where("doc_id = 6").collect()}
    assert {r["text"] for r in rows[6]} == whole and all(r["n_removed"] == 0 for r in rows[6])  # the first of its passages, in both rows
    assert dedup_lines(nothing).count() == 0


def test_repeated_rows_keep_their_first_passage(spark):
    """Equal rows are one document: what is first in it stays in each, later documents and later places lose theirs."""
    passage = "".join(f"this is clause number {i} of the passage, " for i in range(8))
    rows = [(1, passage), (1, passage), (2, "before all, " + passage), (None, passage), (None, passage), (3, passage + "and then, once more, again: " + passage)]
    for copies in (1, 40):  # few and very many occurrences go the same way
        many = rows + [(10 + i, passage) for i in range(copies)]
        out = dedup_lines(spark.createDataFrame(many, "doc_id long, text string")).collect()
        by = {}
        for r in out:
            assert (r["text"] == dict(many)[r["doc_id"]]) == (r["n_removed"] == 0)
            by.setdefault(r["doc_id"], []).append(r["text"])
        assert by[1] == [passage] * 2
        assert by[None] == [""] * 2
        assert by[2] == ["before all, "]
        assert "clause" not in by[3][0] and "once more" in by[3][0]
        assert all(by[10 + i] == [""] for i in range(copies))
    alone = dedup_lines(spark.createDataFrame([(None, passage), (None, passage)], "doc_id long, text string")).collect()
    assert [r["text"] for r in alone] == [passage] * 2
