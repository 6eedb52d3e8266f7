"""Fast exact token ids for a tokenizer that never merges across white space.

The lower-casing word-BPE vocabulary drops white space and merges inside one
pre-token only, so the ids of a text are the ids of its pre-tokens, one after
another. A batch of texts is cut into such units with numpy over its bytes,
the distinct units are encoded by the tokenizers library, and the ids of the
texts are gathered from that table. A word that holds anything but ASCII
letters, digits and plain punctuation goes to the library uncut.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa

from .common import slices_by_bytes

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)

_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = SPACE
_CLASS[ord("a") : ord("z") + 1] = _CLASS[ord("A") : ord("Z") + 1] = LETTER
_CLASS[ord("0") : ord("9") + 1] = DIGIT
_CLASS[128:] = WHOLE
_CLASS[[ord("'"), ord("<")]] = WHOLE  # contractions and special strings
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: The pre-tokenizer pattern for which cutting at white space and at changes of
#: ASCII class is exact (a fixed value of the vocabulary file).
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Letters that normalise to themselves, have one lower-case letter each and
#: never compose with their neighbours; then ASCII punctuation.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:;=-@\[-`{-~]*)")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


_BYTE_LETTERS = dict(enumerate(_byte_letters()))


def cuts_at_units(path: str) -> bool:
    """Whether the tokenizer file has the normaliser and pattern this module relies on."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    normal = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
    pre = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    model = spec.get("model", {})
    return (
        normal == ["NFC", "Replace", "Lowercase"]
        and pre[0].get("pattern", {}).get("Regex") == _PATTERN
        and pre[0].get("behavior") == "Removed"
        and model.get("dropout") is None
        and all("<" in t["content"] and not t["lstrip"] and not t["rstrip"] for t in spec.get("added_tokens", []))
    )


class UnitTokenizer:
    """Token ids of whole texts by way of distinct units.

    ``max_units`` bounds the table kept between batches (about 150 bytes a
    unit); units beyond it are encoded for their batch and forgotten.
    """

    def __init__(self, path: str, max_units: int = 300_000, slice_bytes: int = 2 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.tokenizer.model)  # for what is one pre-token in the byte-level alphabet
        self.max_units, self.slice_bytes = max_units, slice_bytes
        self.slot: dict[bytes, int] = {}
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)
        self.ids = np.zeros(1 << 18, np.uint32)
        self.n_slots = self.n_ids = 0

    def _encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the units, one after another, and the length of each."""
        plain: list[str] = []
        odd: list[str] = []
        parts = np.ones(len(units), np.int64)  # pre-tokens of a plain unit, 0 for others
        for i, unit in enumerate(units):
            text = unit.decode("utf-8")
            if text.isascii() and text.isprintable() and "'" not in text and "<" not in text:
                plain.append(text)
            elif m := _PLAIN.fullmatch(text):
                plain.append(m[1].lower().encode("utf-8").decode("latin-1").translate(_BYTE_LETTERS))
                if m[2]:
                    plain.append(m[2])
                    parts[i] = 2
            else:
                odd.append(text)
                parts[i] = 0
        one = [e.ids for e in self.merges.encode_batch_fast(plain, add_special_tokens=False)]
        two = [e.ids for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, one), np.int64, len(one)))])
        lengths = np.empty(len(units), np.int64)
        last = np.cumsum(parts)
        lengths[:] = ends[last] - ends[last - parts]
        lengths[parts == 0] = np.fromiter(map(len, two), np.int64, len(two))
        flat = np.empty(int(lengths.sum()), np.uint32)
        from_odd = np.repeat(parts == 0, lengths)
        flat[~from_odd] = np.fromiter(chain.from_iterable(one), np.uint32, int(ends[-1]))
        flat[from_odd] = np.fromiter(chain.from_iterable(two), np.uint32, int(from_odd.sum()))
        return flat, lengths

    def _add(self, units: list[bytes]) -> None:
        flat, lengths = self._encoded(units)
        while self.n_slots + len(units) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.n_ids + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        here = slice(self.n_slots, self.n_slots + len(units))
        self.length[here] = lengths
        self.start[here] = self.n_ids + np.cumsum(lengths) - lengths
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_slots += len(units)
        self.n_ids += len(flat)

    def _units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The units of the texts as one array, and how many come before each text."""
        kind = _CLASS[data]
        inside = kind != SPACE
        begins = np.empty(len(data), bool)  # of a word
        begins[0] = True
        np.logical_not(inside[:-1], out=begins[1:])
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= inside
        cuts = np.empty(len(data), bool)  # of a unit
        cuts[0] = True
        np.not_equal(kind[1:], kind[:-1], out=cuts[1:])
        cuts |= kind == DIGIT
        cuts &= inside
        cuts |= begins
        at = np.flatnonzero(cuts)
        lower = _LOWER[data]
        whole = kind == WHOLE
        if whole.any() and len(at):
            word_at = np.flatnonzero(begins)
            odd = np.logical_or.reduceat(whole, word_at)
            first = begins[at]
            at = at[first | ~odd[np.cumsum(first) - 1]]
            if (angle := np.flatnonzero(data == ord("<"))).size:  # special strings keep their case
                for w in np.unique(np.searchsorted(word_at, angle, side="right") - 1):
                    a, b = word_at[w], word_at[w + 1] if w + 1 < len(word_at) else len(data)
                    lower[a:b] = data[a:b]
        packed = lower[inside]
        places = np.cumsum(inside, dtype=np.int32 if len(data) < 1 << 31 else np.int64)[at] - 1
        ends = np.append(places, len(packed)).astype(np.int64)
        array = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(packed)])
        return array, np.searchsorted(at, offsets)

    def _looked_up(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each unit, and the units before each text. May leave slots over the bound."""
        if not (_CLASS[data] != SPACE).any():
            return np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
        units, before = self._units(data, offsets)
        coded = units.dictionary_encode()
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        raw = coded.dictionary.buffers()[2].to_pybytes()
        distinct = [raw[a:b] for a, b in pairwise(ends)]
        slots = np.fromiter((self.slot.get(u, -1) for u in distinct), np.int64, len(distinct))
        if (new := np.flatnonzero(slots < 0)).size:
            fresh = [distinct[i] for i in new]
            slots[new] = self.n_slots + np.arange(len(new))
            room = max(0, self.max_units - self.n_slots)
            self.slot.update(zip(fresh[:room], range(self.n_slots, self.n_slots + min(room, len(fresh))), strict=True))
            self._add(fresh)
        return slots[coded.indices.to_numpy(zero_copy_only=False)], before

    def _forget(self) -> None:
        """Drop what lies over the bound."""
        if self.n_slots > self.max_units:
            self.n_slots = self.max_units
            self.n_ids = int(self.start[self.n_slots - 1] + self.length[self.n_slots - 1]) if self.n_slots else 0

    def _pieces(self, data: np.ndarray, offsets: np.ndarray):
        """Slices of about ``slice_bytes``: (first text, bytes, offsets). A longer text comes in parts cut at white space."""
        for a, b in slices_by_bytes(offsets, self.slice_bytes):
            part, local = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            if b - a > 1 or len(part) <= self.slice_bytes:
                yield a, part, local
                continue
            i = 0
            while i < len(part):
                j = min(len(part), i + self.slice_bytes)
                while j < len(part):
                    spaces = np.flatnonzero(_CLASS[part[j : j + self.slice_bytes]] == SPACE)
                    if spaces.size:
                        j += int(spaces[0])
                        break
                    j = min(len(part), j + self.slice_bytes)
                yield a, part[i:j], np.array([0, j - i], np.int64)
                i = j

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of tokens of each text."""
        out = np.zeros(len(offsets) - 1, np.int64)
        for a, part, local in self._pieces(data, offsets):
            slots, before = self._looked_up(part, local)
            total = np.concatenate([[0], np.cumsum(self.length[slots])])
            out[a : a + len(local) - 1] += np.diff(total[before])
            self._forget()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(first text, ids, id offsets) for slices of the texts; parts of one long text are joined."""
        held: list[np.ndarray] = []
        last = -1
        for a, part, local in self._pieces(data, offsets):
            slots, before = self._looked_up(part, local)
            lengths = self.length[slots]
            total = np.concatenate([[0], np.cumsum(lengths)])
            ids = self.ids[np.repeat(self.start[slots] - total[:-1], lengths) + np.arange(total[-1])]
            self._forget()
            if held and a != last:
                joined = np.concatenate(held)
                yield last, joined, np.array([0, len(joined)], np.int64)
                held = []
            if len(local) == 2:
                held, last = [*held, ids], a
            else:
                yield a, ids, total[before]
        if held:
            joined = np.concatenate(held)
            yield last, joined, np.array([0, len(joined)], np.int64)


_KEPT: dict[str, UnitTokenizer] = {}


def unit_tokenizer(path: str) -> UnitTokenizer:
    """The worker process's tokenizer for ``path``, with its table kept between tasks."""
    if path not in _KEPT:
        _KEPT[path] = UnitTokenizer(path)
    return _KEPT[path]
