"""SentencePiece encoding that keeps original byte spans, and decoding.

Texts are normalised here, by the longest prefix of each place in the model's
compiled character map, and every normalised byte keeps the place it came
from. Pieces are then found on normalised text that the library's own
normaliser leaves alone, and projected through that alignment.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices_by_bytes, texts_of
from .unit_table import Ragged, UnitTable

MARK = "▁".encode()


class CharMap:
    """A compiled character map: a double-array trie of UTF-8 keys and the texts that replace them.

    The blob is a little-endian length, the trie's 32-bit units, and the
    replacements, each ended by a zero byte. A unit holds its label in the low
    8 bits, whether a value follows in bit 8, and the offset of its children
    in bits 10 to 30, counted in steps of 256 where bit 9 is set.
    """

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = np.frombuffer(blob[4 + size :], np.uint8)
        self.zeros = np.flatnonzero(self.texts == 0)

    def _children(self, unit: np.ndarray) -> np.ndarray:
        return (unit >> 10 & 0x1FFFFF) << ((unit & 512) >> 6)

    def longest(self, data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of the longest key that begins at each place and ends by its stop, the replacement's place); 0 and -1 without one."""
        length, value = np.zeros(len(begins), np.int64), np.full(len(begins), -1, np.int64)
        if not len(self.units):
            return length, value
        node = np.full(len(begins), int(self._children(self.units[:1])[0]), np.int64)
        live = np.arange(len(begins))
        depth = 0
        while (live := live[begins[live] + depth < stops[live]]).size:
            byte = data[begins[live] + depth].astype(np.int64)
            at = node[live] ^ byte
            inside = at < len(self.units)
            live, byte, at = live[inside], byte[inside], at[inside]
            unit = self.units[at]
            fits = (unit & 0x800000FF) == byte
            live, at, unit = live[fits], at[fits], unit[fits]
            node[live] = at ^ self._children(unit)
            depth += 1
            ended = (unit >> 8 & 1).astype(bool)
            length[live[ended]] = depth
            value[live[ended]] = self.units[node[live[ended]]] & 0x7FFFFFFF
        return length, value

    def replacement(self, value: np.ndarray) -> Ragged:
        """The replacements at the given places."""
        sizes = self.zeros[np.searchsorted(self.zeros, value)] - value if len(value) else np.empty(0, np.int64)
        total = np.cumsum(sizes)
        return self.texts[np.repeat(value - total + sizes, sizes) + np.arange(total[-1] if len(total) else 0)], sizes


@dataclass(frozen=True)
class Normalised:
    """Normalised bytes of some texts; ``source`` is the original place of each, ``ends`` that after each text's last."""

    data: np.ndarray
    offsets: np.ndarray
    source: np.ndarray
    ends: np.ndarray


@dataclass(frozen=True)
class Normaliser:
    """The model's normalisation: character map, white space, mark before the text."""

    chars: CharMap
    prefix: bool
    squeeze: bool
    escape: bool

    def run(self, data: np.ndarray, offsets: np.ndarray) -> Normalised:
        """All texts at once. Chunks are single characters or keys of the map; a chunk's bytes share its place."""
        begins = np.flatnonzero((data & 0xC0) != 0x80)
        owner = np.searchsorted(offsets, begins, side="right") - 1
        length, value = self.chars.longest(data, begins, offsets[owner + 1])
        own = np.diff(np.append(begins, len(data)))
        if (wide := np.flatnonzero(length > own)).size:  # a key of several characters hides those inside
            kept, reach = np.ones(len(begins), bool), -1
            for i in wide.tolist():
                if begins[i] >= reach:
                    reach = int(begins[i] + length[i])
                    kept[i + 1 : np.searchsorted(begins, reach)] = False
            begins, owner, length, value = begins[kept], owner[kept], length[kept], value[kept]
            own = np.diff(np.append(begins, len(data)))
        mapped = value >= 0
        flat, sizes = self.chars.replacement(value[mapped])
        out_sizes = own.copy()
        out_sizes[mapped] = sizes
        chunk = np.repeat(np.arange(len(begins)), out_sizes)
        out = np.empty(len(chunk), np.uint8)
        from_map = mapped[chunk]
        out[from_map] = flat
        out[~from_map] = data[np.repeat(~mapped, own)]
        first = np.cumsum(out_sizes) - out_sizes
        text_like = np.flatnonzero((out_sizes != 1) | (np.append(out, 0)[first] != 32))[::-1]
        heads = offsets[:-1].copy()
        if self.squeeze:
            heads[owner[text_like]] = begins[text_like]  # the first chunk that is no space, though it may be empty
        return self._spaced(out, begins[chunk], owner[chunk], offsets, heads)

    def _spaced(self, out: np.ndarray, source: np.ndarray, owner: np.ndarray, offsets: np.ndarray, heads: np.ndarray) -> Normalised:
        """White space squeezed, a space put before each text, and spaces written as marks, as the model says."""
        n = len(offsets) - 1
        ends = offsets[1:].copy()
        full = np.diff(offsets) > 0
        if self.squeeze:
            space = out == 32
            first = np.append(True, owner[1:] != owner[:-1])[: len(out)]
            keep = ~space | ~(first | np.append(True, space[:-1])[: len(out)])
            solid = np.flatnonzero(~space)
            last_solid = np.full(n, -1, np.int64)
            last_solid[owner[solid]] = solid
            after = np.arange(len(out)) > last_solid[owner]
            keep &= ~after
            trailing = np.flatnonzero(after)[::-1]  # the first space after the last other byte ends the text
            ends[owner[trailing]] = source[trailing]
            out, source, owner = out[keep], source[keep], owner[keep]
            full = last_solid >= 0
        if self.prefix:
            at = np.searchsorted(owner, np.flatnonzero(full))
            out, source, owner = np.insert(out, at, 32), np.insert(source, at, heads[full]), np.insert(owner, at, np.flatnonzero(full))
        if self.escape and (spaces := np.flatnonzero(out == 32)).size:
            sizes = np.ones(len(out), np.int64)
            sizes[spaces] = 3
            first = np.cumsum(sizes) - sizes
            wide = np.repeat(out, sizes)
            for k in range(3):
                wide[first[spaces] + k] = MARK[k]
            out, source, owner = wide, np.repeat(source, sizes), np.repeat(owner, sizes)
        return Normalised(out, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]), source, ends)


class SpanEncoder:
    """Ids, original byte spans and decoded texts for one model file."""

    def __init__(self, path: str, max_units: int = 200_000, slice_bytes: int = 2 << 20):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kinds = {p.type for p in spec.pieces}
        if spec.trainer_spec.treat_whitespace_as_suffix or kinds & {sentencepiece_model_pb2.ModelProto.SentencePiece.USER_DEFINED}:
            raise ValueError("models with white space as a suffix or pieces of the user's own are not supported")
        n = spec.normalizer_spec
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.normaliser = Normaliser(CharMap(n.precompiled_charsmap), n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces)
        self.names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        #: no piece runs on from another character into a mark, so pieces never cross a place before one
        self.splits = "▁" in self.names and not any(a != "▁" and b == "▁" for name in self.names for a, b in zip(name, name[1:], strict=False))
        n.ClearField("precompiled_charsmap")
        n.name, n.add_dummy_prefix, n.remove_extra_whitespaces = "identity", False, False
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())  # leaves normalised text alone
        self.unknown = self.library.unk_id()
        self.widths = np.array([1 if self.library.is_byte(i) else len(p.encode()) for i, p in enumerate(self.names)], np.int64)
        self.slice_bytes = slice_bytes
        self.table = UnitTable(self.made, max_units)

    def made(self, units: list[bytes]) -> dict[str, Ragged]:
        """Ids of normalised units and the bytes of each piece."""
        texts = [u.decode() for u in units]
        ids = self.plain.encode(texts, num_threads=1)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for own in ids for x in own), np.int64, int(lengths.sum()))
        widths = self.widths[flat]
        if (odd := np.flatnonzero(flat == self.unknown)).size:  # only the piece itself says how long an unknown one is
            firsts = np.cumsum(lengths) - lengths
            for i in np.unique(np.searchsorted(firsts, odd, side="right") - 1).tolist():
                pieces = self.plain.encode(texts[i], return_type="proto").pieces
                widths[firsts[i] : firsts[i] + lengths[i]] = [p.end - p.begin for p in pieces]
        return {"ids": (flat.astype(np.int32), lengths), "widths": (widths.astype(np.int32), lengths)}

    def _edges(self, text: Normalised) -> np.ndarray:
        """Where units begin, and the end."""
        d = text.data
        cut = np.zeros(len(d), bool)
        if self.splits and len(d) > 3:
            mark = np.zeros(len(d), bool)
            mark[:-2] = (d[:-2] == MARK[0]) & (d[1:-1] == MARK[1]) & (d[2:] == MARK[2])
            cut[1:] = mark[1:]
            cut[3:] &= ~mark[:-3]  # a run of marks stays together
        starts = text.offsets[:-1]
        cut[starts[starts < len(d)]] = True
        return np.append(np.flatnonzero(cut), len(d)) if len(d) else np.zeros(1, np.int64)

    def spans(self, data: np.ndarray, offsets: np.ndarray):
        """(first text, id offsets, ids, starts, ends) of slices of the texts; spans count bytes from each text's beginning."""
        for a, b in slices_by_bytes(offsets, self.slice_bytes):
            base = offsets[a : b + 1] - offsets[a]
            text = self.normaliser.run(data[offsets[a] : offsets[b]], base)
            edges = self._edges(text)
            slots = self.table.looked_up(text.data, edges)
            ids, widths = self.table.gathered("ids", slots), self.table.gathered("widths", slots)
            per_unit = self.table.sizes("ids", slots)
            self.table.forget()
            at = np.concatenate([[0], np.cumsum(per_unit)])[np.searchsorted(edges[:-1], text.offsets)] if len(slots) else np.zeros(b - a + 1, np.int64)
            stop = np.cumsum(widths)
            owner = np.repeat(np.arange(b - a), np.diff(at))
            begins = text.source[stop - widths] if len(ids) else stop
            last = stop == text.offsets[owner + 1]
            ends = np.where(last, text.ends[owner], text.source[np.minimum(stop, len(text.source) - 1)]) if len(ids) else stop
            yield a, at, ids, begins - base[owner], ends - base[owner]

    def decoded(self, ids: list[list[int]]) -> list[str]:
        """The library's text of each list of ids."""
        return self.library.decode(ids, num_threads=1) if ids else []


_KEPT: dict[str, SpanEncoder] = {}


def span_encoder(path: str) -> SpanEncoder:
    """The worker process's encoder for ``path``, with its table kept between tasks."""
    if path not in _KEPT:
        _KEPT[path] = SpanEncoder(path)
    return _KEPT[path]


def encode_spans(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, starts, ends, n_spanned, decoded`` for every row of ``docs``.

    Piece i of a text stands for its original bytes ``starts[i]`` to
    ``ends[i]`` (exclusive). What normalisation drops belongs to the piece
    before it, the mark that a model puts before a text has no bytes, and of a
    character in several byte pieces the last has them all, as in the library.
    ``n_spanned`` is the sum of all spans. ``decoded`` is the text of the ids.

    One narrow pass without a shuffle. Results leave in slices of about 2 MB
    of text. A longer text is normalised and looked up as one slice of its own:
    memory follows the longest text, some 100 bytes a byte. Null and empty
    texts have empty arrays, no tokens and an empty decoded text. A null id
    stays null, repeated rows each give a row, an empty table gives none, and
    columns other than the two named are not read. There are no ties.
    """
    kind = docs.schema[id_col].dataType

    def run(batches):
        encoder = span_encoder(model)
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for a, at, ids, starts, ends in encoder.spans(data, offsets):
                n = len(at) - 1
                flat, cuts = ids.tolist(), at.tolist()
                lists = [flat[cuts[i] : cuts[i + 1]] for i in range(n)]
                reach = np.concatenate([[0], np.cumsum(ends - starts)])
                columns = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x.astype(np.int32))) for x in (ids, starts, ends)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, n), pa.array(np.diff(at)), *columns, pa.array(np.diff(reach[at])), pa.array(encoder.decoded(lists), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "starts", "ends", "n_spanned", "decoded"],
                )

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(run, f"doc_id {kind.simpleString()}, n_tokens long, ids array<int>, starts array<int>, ends array<int>, n_spanned long, decoded string")
