"""Alignment of two tokenizers' tokens by coalescing byte intervals.

Both tokenizers cover the same bytes: a space and the text. All tokens of both
are sorted by where they start; a running maximum of their ends breaks them
into groups where a start reaches it, and inside a group tokens that share
bytes are linked. No token of either crosses a space after a word, so this is
done once for each distinct unit between such places and gathered for texts.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices_by_bytes, stored, texts_of
from .sentencepiece_spans import SpanEncoder
from .unit_table import Ragged, UnitTable
from .unit_tokens import _BYTE_LETTERS

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Id pairs whose counts are broadcast: the most frequent ones, so that every other pair is rare.
HOT_PAIRS = 1 << 16


def coalesced(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and each B token; groups are numbered in byte order.

    A group begins where a token's start reaches the largest end before it,
    which is where tokens of both sides end.
    """
    starts, ends = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(np.append(True, starts[order][1:] >= reach[:-1])[: len(order)]) - 1
    return group[: len(starts_a)], group[len(starts_a) :]


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the A and B tokens of every pair that shares a byte; each side ascends and has no gaps."""
    first = np.searchsorted(ends_b, starts_a, side="right")
    n = np.maximum(np.searchsorted(starts_b, ends_a, side="left") - first, 0)
    total = np.cumsum(n)
    a = np.repeat(np.arange(len(n)), n)
    return a, np.arange(len(a)) - np.repeat(total - n, n) + first[a]


class Aligner:
    """Both tokenizers and what is known of units; a byte-level file for A, a SentencePiece model for B that puts a space before a text."""

    def __init__(self, path_a: str, path_b: str, max_units: int = 200_000, slice_bytes: int = 1 << 20):
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SpanEncoder(path_b)
        letters = {c: b for b, c in _BYTE_LETTERS.items()}
        names_a = self.a.get_vocab(with_added_tokens=False)
        self.size_a = self.a.get_vocab_size()
        self.size_b = len(self.b.names)
        self.bytes_a: list[bytes] = [b""] * self.size_a
        for name, i in names_a.items():
            self.bytes_a[i] = bytes(letters[c] for c in name)
        is_byte = self.b.library.is_byte
        self.bytes_b = [bytes([int(p[3:5], 16)]) if is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.b.names)]
        normal = self.b.normaliser
        #: B leaves text alone but for the space before it, and its pieces never cross a place before a space
        self.splits = self.b.splits and normal.prefix and normal.escape and not normal.squeeze and not len(normal.chars.units)
        self.slice_bytes = slice_bytes
        self.table = UnitTable(self.made, max_units)

    def _tokens(self, ids: list[list[int]], names: list[bytes], units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids of each unit, bytes of each id, and which units the ids' bytes spell."""
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.int64, int(n.sum()))
        width = np.fromiter((len(names[x]) for x in flat.tolist()), np.int64, len(flat))
        same = np.fromiter((b"".join([names[x] for x in own]) == u for own, u in zip(ids, units, strict=True)), bool, len(ids))
        return flat, n, width, same

    def made(self, units: list[bytes]) -> dict[str, Ragged]:
        """By unit: whether both spell it, counts, group text (ended by a semicolon) and linked id pairs."""
        texts = [u.decode() for u in units]
        ids_a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        # a unit begins with a space, which is the one that B puts before a text
        ids_b = self.b.plain.encode([t.replace(" ", "▁") for t in texts], num_threads=1) if self.splits else self.b.library.encode([t[1:] for t in texts], num_threads=1)
        flat_a, n_a, width_a, same_a = self._tokens(ids_a, self.bytes_a, units)
        flat_b, n_b, width_b, same_b = self._tokens(ids_b, self.bytes_b, units)
        same = same_a & same_b
        keep_a, keep_b = np.repeat(same, n_a), np.repeat(same, n_b)
        flat_a, width_a, flat_b, width_b = flat_a[keep_a], width_a[keep_a], flat_b[keep_b], width_b[keep_b]
        n_a, n_b = n_a * same, n_b * same
        ends_a, ends_b = np.cumsum(width_a), np.cumsum(width_b)
        starts_a, starts_b = ends_a - width_a, ends_b - width_b
        group_a, group_b = coalesced(starts_a, ends_a, starts_b, ends_b)
        # tokens in the order of the group text: by group, A before B, then by place
        side = np.repeat([0, 1], [len(flat_a), len(flat_b)])
        group = np.concatenate([group_a, group_b])
        order = np.lexsort((np.concatenate([starts_a, starts_b]), side, group))
        side, group, owner = side[order], group[order], np.concatenate([np.repeat(np.arange(len(units)), n_a), np.repeat(np.arange(len(units)), n_b)])[order]
        after = np.where(np.append(group[1:] != group[:-1], True)[: len(group)], 2, np.where(np.append(side[1:] != side[:-1], True)[: len(group)], 1, 0))
        said = [f"{x}{',|;'[k]}" for x, k in zip(np.concatenate([flat_a, flat_b])[order].tolist(), after.tolist(), strict=True)]
        lengths = np.fromiter(map(len, said), np.int64, len(said))
        per_unit = np.bincount(owner, lengths, len(units)).astype(np.int64)
        groups = np.bincount(owner[after == 2], minlength=len(units))
        a, b = overlaps(starts_a, ends_a, starts_b, ends_b)
        links = np.bincount(np.repeat(np.arange(len(units)), n_a)[a], minlength=len(units)) if len(a) else np.zeros(len(units), np.int64)
        numbers = np.stack([same, n_a, n_b, groups, links], axis=1).astype(np.int64)
        return {
            "numbers": (numbers.ravel(), np.full(len(units), 5)),
            "text": (np.frombuffer("".join(said).encode(), np.uint8), per_unit),
            "pairs": (flat_a[a] * self.size_b + flat_b[b], links),
        }

    def edges(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Where units begin, and the end: at texts, and at a space after a character that is surely not white space."""
        cut_at = np.zeros(len(data), bool)
        if self.splits:
            before = data[:-1]
            solid = (before > 32) & (before < 127)
            solid[1:] |= (before[1:] >= 0x80) & (before[:-1] >= 0xC3) & (before[:-1] <= 0xDF)  # letters of two bytes
            cut_at[1:] = solid & (data[1:] == 32)
        cut_at[starts] = True
        return np.append(np.flatnonzero(cut_at), len(data))

    def texts(self, data: np.ndarray, offsets: np.ndarray):
        """(first text, numbers, group texts, pair offsets, pairs, times) of slices of the texts; texts without tokens have zeros."""
        for first, last in slices_by_bytes(offsets, self.slice_bytes):
            n = last - first
            base = offsets[first : last + 1] - offsets[first]
            full = np.flatnonzero(np.diff(base) > 0)
            spaced = np.insert(data[offsets[first] : offsets[last]], base[full], 32)
            starts = base[full] + np.arange(len(full))
            numbers, said = np.zeros((n, 4), np.int64), [b""] * n
            codes, times, ends = np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n + 1, np.int64)
            if len(full):
                edges = self.edges(spaced, starts)
                slots = self.table.looked_up(spaced, edges)
                owner = full[np.searchsorted(starts, edges[:-1], side="right") - 1]
                known = self.table.gathered("numbers", slots).reshape(-1, 5)
                wrong = np.zeros(n, bool)
                wrong[owner[known[:, 0] == 0]] = True
                slots, known, owner = slots[~wrong[owner]], known[~wrong[owner]], owner[~wrong[owner]]
                for k in range(4):
                    numbers[:, k] = np.bincount(owner, known[:, k + 1], n)
                text = self.table.gathered("text", slots).astype(np.uint8).tobytes()
                cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, self.table.sizes("text", slots), n))]).astype(np.int64).tolist()
                said = [text[cuts[i] : max(cuts[i], cuts[i + 1] - 1)] for i in range(n)]
                pairs = self.table.gathered("pairs", slots)
                holder = np.repeat(owner, self.table.sizes("pairs", slots))
                self.table.forget()
                order = np.lexsort((pairs, holder))
                pairs, holder = pairs[order], holder[order]
                new = np.flatnonzero(np.append(True, (pairs[1:] != pairs[:-1]) | (holder[1:] != holder[:-1]))[: len(pairs)])
                codes, times = pairs[new], np.diff(np.append(new, len(pairs)))
                ends = np.concatenate([[0], np.cumsum(np.bincount(holder[new], minlength=n))])
            yield first, numbers, said, ends, codes, times


_KEPT: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """The worker process's aligner, with its table kept between tasks."""
    if (path_a, path_b) not in _KEPT:
        _KEPT[path_a, path_b] = Aligner(path_a, path_b)
    return _KEPT[path_a, path_b]


def aligned(docs: DataFrame, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` for every row of ``docs``.

    ``pairs`` holds the text's distinct linked id pairs, ascending, as A's id
    times the size of B's vocabulary plus B's id; ``times`` how often each is
    linked. Null and empty texts, and texts that the tokens of either side do
    not spell, have zeros, an empty digest and no pairs.
    """
    kind = docs.schema["doc_id"].dataType

    def run(batches):
        both = aligner(tokenizer_a, tokenizer_b)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for first, numbers, said, ends, codes, times in both.texts(data, offsets):
                n = len(said)
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, n),
                        *(pa.array(numbers[:, k]) for k in range(4)),
                        pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in said], pa.string()),
                        pa.ListArray.from_arrays(at, pa.array(codes)),
                        pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32))),
                    ],
                    names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """``pair, n, best``: in how many rows of ``aligned`` a pair is linked, and whether no pair of its A id is in more."""
    counts = cut(found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")))
    a = F.expr(f"pair div {size_b}L")
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokens(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, size_b: int, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row of ``docs``.

    A pair's count is the number of rows that hold it linked. ``n_best``
    counts links whose pair has its A id's highest count, ties included, and
    ``count_sum`` adds the counts of all links.

    Texts are tokenized once and their distinct pairs stored. Counts are
    summed before they are shuffled. The ``hot_pairs`` most frequent pairs are
    broadcast, a fixed number of rows, and summed where their text is; other
    pairs, each in at most one of ``hot_pairs`` entries, meet their counts in a
    join. Rows are told apart by a number of their own: repeated rows each
    count and each give a row, null ids stay null, and other columns are not
    read. Null and empty texts have zeros; an empty table gives no rows. Memory
    follows the longest text, some 200 bytes a byte.
    """
    found = stored(aligned(docs, tokenizer_a, tokenizer_b).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = cut(pair_counts(found, size_b))
    hot = cut(counts.orderBy(F.desc("n"), "pair").limit(hot_pairs))
    entries = found.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    summed = [F.sum(F.col("times") * F.col("n")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best")]
    near = entries.join(F.broadcast(hot), "pair").groupBy("row").agg(*summed)
    far = entries.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(counts, "pair").groupBy("row").agg(*summed)
    sums = near.unionByName(far).groupBy("row").agg(F.sum("count_sum").alias("count_sum"), F.sum("n_best").alias("n_best"))
    out = found.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
