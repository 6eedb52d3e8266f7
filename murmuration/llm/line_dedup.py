"""Line dedup by overlapping three-line windows, in built-in functions only.

A line is a physical line, cut further after a sentence or clause mark and
after a long word. Corpora often hold a paragraph per line, and a passage
pasted inside one would otherwise share no whole line with its other copies;
cuts that depend on the words alone fall at the same places in every copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let, stored

#: Places after a line feed, or after the white space that follows a mark or nine characters of one word.
BREAKS = r"(?<=[ \n\t\r])(?:(?<=\n)|(?<=[.!?,;:][ \n\t\r])|(?<=[^ \n\t\r]{9}[ \n\t\r]))"  # most places fail at the first test
TRIMMED = " \n\t\r"
#: Bits of the filter that windows pass before they are shuffled: 2**25 at most, half a million broadcast rows.
MOST_BITS = 25


def lines_of(text: Column) -> Column:
    """The lines of a text with what ends them; joined they give the text back."""
    return F.split(F.coalesce(text, F.lit("")), BREAKS, -1)


def _windows(hashed: DataFrame, lines: int) -> DataFrame:
    """``doc_id, mark, at, c0, c1, ...``: a row for each window, with the hashes of its lines and its first line's number."""
    columns = [F.slice("hashes", k + 1, 1 << 30).alias(f"c{k}") for k in range(lines)]
    at = F.sequence(F.lit(0), F.size("hashes") - 1).alias("at")
    out = hashed.where(F.size("hashes") >= lines).select("doc_id", "mark", F.inline(F.arrays_zip(at, *columns)))
    return out.where(F.col(f"c{lines - 1}").isNotNull())


def _word(h: Column, bits: int) -> Column:
    return F.shiftright(h.bitwiseAND(F.lit((1 << bits) - 1)), 6).cast("int")


def _bitmap(hashes: DataFrame) -> tuple[DataFrame, int]:
    """(``word, bits`` of a bitmap over the low bits of ``hashes(h)``, its size as a power of 2).

    It has 16 bits for each hash up to a fixed size, which bounds what is
    broadcast. It only saves shuffles: what it lets through is compared exactly.
    """
    bits = min(MOST_BITS, max(10, (16 * hashes.count()).bit_length()))
    words = hashes.select(_word(F.col("h"), bits).alias("word"), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
    return cut(words.groupBy("word").agg(F.bit_or("bit").alias("bits"))), bits


def _marked(rows: DataFrame, h: Column, bitmap: tuple[DataFrame, int]) -> DataFrame:
    """``rows`` with ``in_bitmap``, whether the bitmap has the hash."""
    words, bits = bitmap
    joined = rows.withColumn("word", _word(h, bits)).join(F.broadcast(words), "word", "left")
    # a shift of a long counts by the low six bits of its second argument
    return joined.withColumn("in_bitmap", F.call_function("shiftright", F.coalesce("bits", F.lit(0).cast("long")), h.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1).drop("word", "bits")


def repeated_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """``doc_id, mark, covered``: ascending numbers of the lines that later occurrences of windows cover.

    Texts are cut once, and only line hashes go on. A grouped count of window
    hashes (combined before the shuffle, so a window in very many documents is
    one row a task) finds what repeats; only occurrences that may be of those
    go further, and there a window is two hashes of its line hashes. The first
    place of each window is a grouped minimum. All other places are later
    ones, so places and first places meet by document, never by window: no
    window is gathered, however frequent. Beyond some two million repeated
    windows the bitmap lets nearly every occurrence through; what follows is
    still combined in each task before it is shuffled.
    """
    rtrimmed = F.transform(lines_of(F.col("text")), lambda x: F.xxhash64(F.rtrim(x, F.lit(TRIMMED))))
    hashed = stored(docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("mark"), rtrimmed.alias("hashes")), "line-hashes")
    windows, names = _windows(hashed, lines), [f"c{k}" for k in range(lines)]
    both = windows.select("doc_id", "mark", "at", F.xxhash64(*names).alias("h"), F.xxhash64(F.lit(1), *names).alias("check"))
    repeated = cut(both.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    found = stored(_marked(both, F.col("h"), _bitmap(repeated)).where("in_bitmap").select("doc_id", "mark", "at", "h", "check"), "windows")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "mark", "at")
    firsts = found.groupBy("h", "check").agg(F.min(place).alias("first")).select("first.doc_id", "first.mark", "first.at", F.lit(True).alias("is_first"))
    places = found.select("doc_id", "mark", "at", F.lit(False).alias("is_first")).unionByName(firsts)
    each = places.groupBy("doc_id", "mark").agg(F.collect_set(F.when(~F.col("is_first"), F.col("at"))).alias("all"), F.collect_set(F.when(F.col("is_first"), F.col("at"))).alias("first"))
    merged = each.select("doc_id", "mark", F.array_except("all", "first").alias("starts")).where(F.size("starts") > 0)
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.sequence(i, i + lines - 1)))))
    return merged.select("doc_id", "mark", covered.alias("covered"))


def _runs(covered: Column, lines: Column, min_chars: int) -> Column:
    """(first, last) of each run of consecutive line numbers that has enough characters."""
    before = F.arrays_zip(covered.alias("x"), F.concat(F.array(F.lit(-2)), covered).alias("other"))
    after = F.arrays_zip(covered.alias("x"), F.concat(F.slice(covered, 2, 1 << 30), F.array(F.lit(1 << 30))).alias("other"))
    first = F.filter(before, lambda e: e["x"] - e["other"] > 1)
    last = F.filter(after, lambda e: e["other"] - e["x"] > 1)
    runs = F.zip_with(first, last, lambda a, b: F.struct(a["x"].alias("first"), b["x"].alias("last")))

    def chars(run):
        return F.length(F.array_join(F.slice(lines, run["first"] + 1, run["last"] - run["first"] + 1), ""))

    return F.filter(runs, lambda run: chars(run) >= min_chars)


def _without(lines: Column, runs: Column) -> Column:
    """(text, n_removed) of the lines outside the runs: what stands between them, joined."""
    ends = F.concat(F.array(F.lit(-1)), F.transform(runs, lambda r: r["last"]))
    begins = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    between = F.zip_with(ends, begins, lambda a, b: F.array_join(F.slice(lines, a + 2, b - a - 1), ""))
    return F.struct(F.array_join(between, "").alias("text"), F.aggregate(runs, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1).alias("n_removed"))


def dedup_lines(docs: DataFrame, lines: int = 3, min_chars: int = 60, removed: str = "n_removed") -> DataFrame:
    """All columns of ``docs``, with later copies of repeated passages gone from ``text``, then a count named by ``removed``.

    Every window of ``lines`` consecutive lines is hashed. Of a window that
    occurs again anywhere, the first occurrence (smallest doc_id, then place;
    rows without one come last) stays, and the lines that others cover are
    merged into runs. A run of ``min_chars`` characters goes; shorter ones are
    common phrases and stay (0 removes every run). The count is of lines.

    A text of fewer lines is left alone; null and empty texts are unchanged
    with 0 removed. A very long text is one row throughout, with 8 bytes a
    line. Rows that agree in doc_id and text count as one document: each keeps
    what is first in it and loses what an earlier document or an earlier place
    in it has. An empty table stays empty. Other columns pass through
    whatever their names; the added one replaces a column of the same name.
    """
    found = cut(repeated_lines(docs, lines)).withColumnsRenamed({"doc_id": "found_id", "mark": "found_mark"})
    named = _marked(docs.select(F.struct("*").alias("row"), F.xxhash64("text").alias("own")), F.col("own"), _bitmap(found.select(F.col("found_mark").alias("h"))))
    # only texts with something covered are shuffled and cut again
    joined = named.where("in_bitmap").join(found, F.col("row.doc_id").eqNullSafe(F.col("found_id")) & (F.col("own") == F.col("found_mark")), "left")
    rest = F.when(F.col("covered").isNotNull(), let(lines_of(F.col("row.text")), lambda v: let(_runs(F.col("covered"), v, min_chars), lambda runs: _without(v, runs))))
    out = joined.withColumn("rest", rest)
    n_removed = F.coalesce("rest.n_removed", F.lit(0))
    text = F.when(n_removed > 0, F.col("rest.text")).otherwise(F.col("row.text"))
    order = [c for c in docs.columns if c.lower() != removed.lower()]
    changed = out.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in order], n_removed.alias(removed))
    return changed.unionByName(named.where("not in_bitmap").select(*[F.col("row")[c].alias(c) for c in order], F.lit(0).alias(removed)))
