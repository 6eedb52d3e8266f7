"""Benchmark decontamination by SimHash over item-sized windows.

Each item is one fingerprint of its five-word shingles; a document's windows
of the same number of words are fingerprinted too. A multi-index over blocks
of the fingerprint (Norouzi et al., 2012) finds every item within a Hamming
radius that follows from the threshold, and an exact weighted similarity of
the shingles decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import slices_by_bytes, texts_of
from .shingles import SLICE_BYTES, window_hashes, word_hashes


@dataclass(frozen=True)
class Search:
    """``radius`` bits of 64 at least. With 8 blocks, a fingerprint within 15 differs
    from the item's in one bit at most in some block, so looking up each block's
    value and its 8 neighbours misses none; within 23, in two bits at most.

    ``items_at_once`` and ``item_bytes_at_once`` bound what is broadcast: more
    items are searched in blocks, each with a pass of its own over the
    documents. ``windows_at_once`` bounds the fingerprints of one text that
    stand in memory.
    """

    width: int = 5
    threshold: float = 0.8
    radius: int = 15
    blocks: int = 8
    items_at_once: int = 20_000
    item_bytes_at_once: int = 32 << 20
    windows_at_once: int = 4096
    miss: float = 2e-5

    @cached_property
    def reach(self) -> int:
        """Bits that windows at the threshold differ in, but for a share of ``miss`` by the binomial tail; no less than ``radius``."""
        shared = 2 * self.threshold / (1 + self.threshold)
        p = math.acos(min(1.0, shared)) / math.pi
        tail = np.cumsum([math.comb(64, k) * p**k * (1 - p) ** (64 - k) for k in range(64, -1, -1)])[::-1]  # from k bits on
        return max(self.radius, int(np.flatnonzero(np.append(tail[1:], 0.0) < self.miss)[0]))


def _signs(values: np.ndarray) -> np.ndarray:
    """Each shingle's 64 bits as +1 and -1."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int16) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints from summed signs (rows x 64)."""
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").reshape(-1)


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over joined weight; a shingle weighs as often as it occurs."""
    values = np.unique(np.concatenate([a, b]))
    m, n = (np.bincount(np.searchsorted(values, x), minlength=len(values)) for x in (a, b))
    return float(np.minimum(m, n).sum() / np.maximum(m, n).sum())


class Items:
    """A bounded block of benchmark items, laid out for lookup.

    ``texts`` shorter than the shingle width have no shingle and are left out.
    """

    def __init__(self, texts: list[str | None], search: Search):
        data, offsets = texts_of(pa.array(texts, pa.string()))
        words, before = word_hashes(data, offsets)
        values, ends = window_hashes(words, before, search.width)
        n = np.diff(before)
        self.search = search
        self.sizes = np.where(n >= search.width, n, 0)
        self.shingles = [values[ends[i] : ends[i + 1]] if self.sizes[i] else np.empty(0, np.uint64) for i in range(len(texts))]
        self.prints = np.array([simhash(_signs(s).sum(axis=0, dtype=np.int64)[None])[0] if len(s) else 0 for s in self.shingles], np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in self.shingles])
        flat = np.concatenate([*self.shingles, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.known, first = np.unique(flat[order], return_index=True)
        self.owners = owner[order]
        self.owner_cuts = np.append(first, len(flat))
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.known & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.by_size = {int(m): np.flatnonzero(self.sizes == m) for m in np.unique(self.sizes[self.sizes > 0])}
        self.index: dict[tuple[int, int], np.ndarray] = {}  # by size and radius, built where first needed

    def hits(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of shingles that some item has, and their places in ``known``."""
        at = np.flatnonzero(self.filter[(values & np.uint64((1 << 20) - 1)).astype(np.int64)])
        place = np.searchsorted(self.known, values[at])
        real = self.known[np.minimum(place, len(self.known) - 1)] == values[at] if len(self.known) else np.zeros(len(at), bool)
        return at[real], place[real]

    def within(self, size: int, prints: np.ndarray, radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``prints``, item of that size) for all pairs within the radius."""
        members, blocks = self.by_size[size], self.search.blocks
        radius = self.search.radius if radius is None else radius
        bits = 64 // blocks
        if (size, radius) not in self.index:
            near = np.zeros((blocks, 1 << bits, len(members)), bool)
            most = radius // blocks  # errors that some block stays within
            masks = [0] if most == 0 else [0, *(1 << i for i in range(bits))]
            if most > 1:
                masks = [m for m in range(1 << bits) if m.bit_count() <= most]
            for b in range(blocks):
                own = (self.prints[members] >> np.uint64(b * bits)).astype(np.int64) & ((1 << bits) - 1)
                for mask in masks:
                    near[b, own ^ mask, np.arange(len(members))] = True
            self.index[size, radius] = near
        near = self.index[size, radius]
        maybe = np.zeros((len(prints), len(members)), bool)
        for b in range(blocks):
            maybe |= near[b, (prints >> np.uint64(b * bits)).astype(np.int64) & ((1 << bits) - 1)]
        row, item = np.nonzero(maybe)
        close = np.bitwise_count(prints[row] ^ self.prints[members[item]]) <= radius
        return row[close], members[item[close]]


def _windows_with(hits: np.ndarray, n_shingles: int, span: int) -> Iterator[tuple[int, int]]:
    """Ranges of first shingles of windows of ``span`` shingles that hold a hit."""
    last_start = max(0, n_shingles - span)
    low, high = np.maximum(0, hits - span + 1), np.minimum(last_start, hits)
    begins = np.flatnonzero(np.concatenate([[True], low[1:] > np.maximum.accumulate(high)[:-1] + 1]))
    ends = np.append(begins[1:], len(hits)) - 1
    for i, j in zip(begins, ends, strict=True):
        yield int(low[i]), int(high[j])


def _pieces(ranges: Iterator[tuple[int, int]], most: int) -> Iterator[tuple[int, int]]:
    """The same ranges, in pieces of ``most`` at most."""
    for low, high in ranges:
        for a in range(low, high + 1, most):
            yield a, min(high, a + most - 1)


def leaks_in(data: np.ndarray, offsets: np.ndarray, items: Items) -> Iterator[tuple[int, int, int, float]]:
    """(text, item, first word, similarity): the best window of each pair that reaches the threshold.

    A text that shares fewer shingles with an item than the threshold needs
    can't reach it, so only windows with shingles of the other items are
    fingerprinted. A text shorter than an item is one window.
    """
    search = items.search
    n_shingles = np.maximum(items.sizes - search.width + 1, 0)
    for a, b in slices_by_bytes(offsets, SLICE_BYTES):
        part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        words, before = word_hashes(part, local)
        values, ends = window_hashes(words, before, search.width)
        at, place = items.hits(values)
        if not len(at):
            continue
        owner = np.searchsorted(ends, at, side="right") - 1
        for text in np.unique(owner):
            mine = owner == text
            own = values[ends[text] : ends[text + 1]]
            if before[text + 1] - before[text] < search.width:
                continue
            local_at, local_place = at[mine] - ends[text], place[mine]
            counts = items.owner_cuts[local_place + 1] - items.owner_cuts[local_place]
            found_items = items.owners[np.repeat(items.owner_cuts[local_place] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())]
            hit_at = np.repeat(local_at, counts)
            # of a + b shingles, a similarity of s needs s / (1 + s) * (a + b) in common; at most each place of the text is one
            named, which, places = np.unique(found_items, return_inverse=True, return_counts=True)
            spans = np.minimum(n_shingles[named], len(own))
            able = places >= search.threshold / (1 + search.threshold) * (spans + n_shingles[named]) - 1e-6
            if not able.any():
                continue
            found_items, hit_at = found_items[able[which]], hit_at[able[which]]
            best: dict[int, tuple[float, int]] = {}
            for size in np.unique(items.sizes[found_items]):
                span = min(int(size) - search.width + 1, len(own))
                hits = np.unique(hit_at[items.sizes[found_items] == size])
                for low, high in _pieces(_windows_with(hits, len(own), span), search.windows_at_once):
                    signs = _signs(own[low : high + span])
                    run = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs, axis=0, dtype=np.int32)])
                    sums = run[span:] - run[:-span]
                    row, item = items.within(int(size), simhash(sums), search.reach)
                    sought = np.isin(item, named[able])
                    row, item = row[sought], item[sought]
                    for r, t in zip(row.tolist(), item.tolist(), strict=True):
                        share = weighted_similarity(own[low + r : low + r + span], items.shingles[t])
                        if share >= search.threshold and share > best.get(t, (0.0, 0))[0]:
                            best[t] = (share, low + r)
            for t, (share, first) in sorted(best.items()):
                yield a + int(text), t, first, share


def _item_blocks(benchmark: DataFrame, search: Search) -> Iterator[tuple[list, Items]]:
    """Blocks of items of bounded size, each with the items' ids."""
    wanted = benchmark.select("item_id", "text").where("text is not null").distinct()
    n, size = wanted.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n_blocks = max(1, -(-n // search.items_at_once), -(-(size or 0) // search.item_bytes_at_once))
    for k in range(n_blocks):
        mine = wanted if n_blocks == 1 else wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k)
        rows = sorted((tuple(r) for r in mine.collect()), key=str)
        yield [r[0] for r in rows], Items([r[1] for r in rows], search)


def leaks(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """``doc_id, item_id, first_word, similarity`` of every leak, one row for a document row and item.

    The items are searched in blocks of ``items_at_once``, so what tasks hold
    is bounded however large the benchmark is; documents are not shuffled.

    Null and empty texts and items have no leak, nor do items under five
    words, which hold no shingle to compare. Null doc_ids are searched and
    reported as null; repeated documents are reported each and repeated items
    once; an empty table on either side gives no rows. Very long texts are
    searched whole, their windows some thousands at a time. Further columns
    are not read.
    """
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"doc_id {id_kind}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, first_word int, similarity double"
    narrow = docs.select("doc_id", "text")
    out = None
    for ids, items in _item_blocks(benchmark, search):

        def run(batches, ids=ids, items=items):
            item_ids = pa.array(ids, item_type)
            for batch in batches:
                data, offsets = texts_of(batch.column(1))
                found = list(leaks_in(data, offsets, items))
                if found:
                    text, item, first, share = (pa.array(list(x)) for x in zip(*found, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(text), item_ids.take(item), first.cast(pa.int32()), share.cast(pa.float64())],
                        names=["doc_id", "item_id", "first_word", "similarity"],
                    )

        one = narrow.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, search: Search = Search()) -> DataFrame:
    """The rows of ``docs`` without a leak, with all their columns, by a narrow pass per block of items.

    Each row is judged by its own text, so null and repeated doc_ids are no
    special case.
    """
    at = docs.columns.index("text")
    for _, items in _item_blocks(benchmark, search):

        def run(batches, items=items):
            for batch in batches:
                data, offsets = texts_of(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                clean[[text for text, *_ in leaks_in(data, offsets, items)]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
