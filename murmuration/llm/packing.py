"""Best-fit packing of documents into sequences under several capacities."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of
from .unit_tokens import cuts_at_units, unit_tokenizer


@dataclass(frozen=True)
class Capacities:
    """What a sequence may hold, and how much each dimension weighs in the choice.

    ``documents`` bounds the pieces of a sequence, so a table of very short
    texts doesn't make sequences of thousands of masks. ``attention`` bounds
    the sum of squared piece lengths, which is what block-diagonal attention
    over the sequence costs; it can't be under the square of ``tokens`` where
    pieces as long as a sequence have to fit. ``rule`` is
    ``"residual"`` (smallest weighted norm of what stays free) or ``"dot"``
    (largest weighted dot-product of demand and free room).
    """

    tokens: int = 2048
    documents: int = 256
    attention: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    rule: str = "residual"


def demands(lengths: np.ndarray) -> np.ndarray:
    """Tokens, documents and attention cost of pieces, as integers."""
    lengths = np.asarray(lengths, np.int64)
    return np.stack([lengths, np.ones_like(lengths), lengths * lengths], axis=1)


def best_fit(lengths: np.ndarray, caps: Capacities) -> tuple[np.ndarray, np.ndarray]:
    """Bin and token offset of each piece: vector best-fit, longest first.

    Every bin that meets all three capacities is weighed; where none does, one
    is opened. Bins of the same free room are interchangeable, so they stand
    in one stack, and the choice looks at distinct rooms only. A piece that
    exceeds a capacity by itself is an error.
    """
    need = demands(lengths)
    full = np.array([caps.tokens, caps.documents, caps.attention], np.int64)
    if len(need) and (need > full).any():
        raise ValueError("a piece exceeds a capacity by itself")
    weight = np.asarray(caps.weights, float) / full
    order = np.argsort(-need[:, 0], kind="stable")
    bins, offsets = np.empty(len(need), np.int64), np.empty(len(need), np.int64)
    rooms = np.zeros((256, 3), np.int64)  # distinct free rooms
    weighted = np.zeros((256, 3))  # the same, by capacity and weight
    stacks: list[list[int]] = []
    where: dict[tuple[int, int, int], int] = {}
    unused: list[int] = []
    opened = 0
    for item in order.tolist():
        ask = need[item]
        m = len(stacks)
        fits = np.flatnonzero((rooms[:m] >= ask).all(axis=1))
        if fits.size:
            asked = ask * weight
            if caps.rule == "dot":
                pick = int(fits[np.argmax(weighted[fits] @ asked)])
            else:
                pick = int(fits[np.argmin(((weighted[fits] - asked) ** 2).sum(axis=1))])
            room = rooms[pick].copy()
            bin_id = stacks[pick].pop()
            if not stacks[pick]:
                del where[tuple(room.tolist())]
                rooms[pick] = -1
                unused.append(pick)
        else:
            room, bin_id = full, opened
            opened += 1
        bins[item] = bin_id
        offsets[item] = caps.tokens - room[0]
        room = room - ask
        if room[0] > 0 and room[1] > 0 and room[2] > 0:
            key = tuple(room.tolist())
            slot = where.get(key)
            if slot is None:
                if unused:
                    slot = unused.pop()
                else:
                    slot = len(stacks)
                    stacks.append([])
                    if slot == len(rooms):
                        rooms, weighted = (np.concatenate([x, np.zeros_like(x)]) for x in (rooms, weighted))
                rooms[slot], weighted[slot] = room, room * weight
                where[key] = slot
            stacks[slot].append(bin_id)
    return bins, offsets


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, deal`` of every document.

    A document's ids end with ``end_id``; only longer ones than ``limit`` are
    cut. ``deal`` is a hash that differs between repeated rows too.
    """
    if not cuts_at_units(tokenizer):
        raise ValueError("packing needs a tokenizer that does not merge across white space")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        units, row = unit_tokenizer(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for a, ids, at in units.encode(data, offsets):
                n = len(at) - 1
                ended = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                lengths = np.diff(at) + 1
                first = np.cumsum(lengths) - lengths
                pieces = -(-lengths // limit)
                owner = np.repeat(np.arange(n), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * limit
                length = np.minimum(limit, lengths[owner] - start)
                begin = (first[owner] + start).tolist()
                view = memoryview(ended.tobytes())
                sums = [zlib.crc32(view[4 * b : 4 * (b + k)]) for b, k in zip(begin, length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n).take(pa.array(owner)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()), pa.array(row + np.arange(len(owner)))],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
                )
                row += len(owner)
            pa.default_memory_pool().release_unused()

    narrow = docs.select("doc_id", "text")
    out = narrow.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, row long")
    return out.withColumn("deal", F.xxhash64("doc_id", "piece", "row")).drop("row")


def pack(docs: DataFrame, tokenizer: str, end_id: int, caps: Capacities = Capacities(), block_pieces: int = 4096) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` of all pieces.

    Pieces are dealt by hash into blocks of about ``block_pieces`` and each
    block is packed by itself, so a task's memory does not grow with the
    table, and a block wastes one partly filled sequence at most. Bins of a
    block have ids of their own range.

    Null and empty texts are one piece with the end id; null doc_ids and
    repeated rows are packed like others; an empty table gives no rows.
    """
    pieces = cut(token_pieces(docs, tokenizer, end_id, caps.tokens))
    blocks = max(1, -(-pieces.count() // block_pieces))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        # the hash orders ties, so a retry packs the same way
        table = table.sort_by([("length", "descending"), ("deal", "ascending")])
        bins, offsets = best_fit(table.column("length").to_numpy(), caps)
        block = table.column("block").to_numpy().astype(np.int64)
        kept = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        return kept.append_column("sequence_id", pa.array((block << 32) | bins)).append_column("offset", pa.array(offsets))

    dealt = pieces.withColumn("block", F.pmod("deal", F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
