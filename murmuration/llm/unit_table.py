"""What is computed once for each distinct unit of text, and gathered for whole texts."""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

import numpy as np
import pyarrow as pa

#: (flat values of all units one after another, how many each unit has)
Ragged = tuple[np.ndarray, np.ndarray]


class UnitTable:
    """Ragged columns by unit, filled by ``make`` and kept between batches.

    ``make`` takes distinct units and gives named columns. ``max_units`` bounds
    what is kept; units beyond it are made for their batch and forgotten.
    """

    def __init__(self, make: Callable[[list[bytes]], dict[str, Ragged]], max_units: int = 200_000):
        self.make, self.max_units = make, max_units
        self.slot: dict[bytes, int] = {}
        self.columns: dict[str, list[np.ndarray]] = {}
        self.n = 0

    def looked_up(self, data: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The slot of each unit; unit i is ``data[edges[i]:edges[i + 1]]``. Valid until ``forget``."""
        if len(edges) < 2:
            return np.empty(0, np.int64)
        edges = np.ascontiguousarray(edges, np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        ends = np.frombuffer(coded.dictionary.buffers()[1], np.int64)[: len(coded.dictionary) + 1].tolist()
        raw = coded.dictionary.buffers()[2].to_pybytes()
        distinct = [raw[a:b] for a, b in pairwise(ends)]
        slots = np.fromiter((self.slot.get(u, -1) for u in distinct), np.int64, len(distinct))
        if (new := np.flatnonzero(slots < 0)).size:
            fresh = [distinct[i] for i in new]
            slots[new] = self.n + np.arange(len(new))
            room = max(0, self.max_units - self.n)
            self.slot.update(zip(fresh[:room], range(self.n, self.n + min(room, len(fresh))), strict=True))
            self._add(self.make(fresh), len(fresh))
        return slots[coded.indices.to_numpy(zero_copy_only=False)]

    def _add(self, columns: dict[str, Ragged], units: int) -> None:
        for name, (flat, lengths) in columns.items():
            if name not in self.columns:  # values, starts, lengths, values in use
                self.columns[name] = [np.zeros(1 << 16, flat.dtype), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1, np.int64)]
            values, starts, sizes, used = self.columns[name]
            while int(used[0]) + len(flat) > len(values):
                values = np.concatenate([values, np.zeros_like(values)])
            while self.n + units > len(starts):
                starts, sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (starts, sizes))
            values[used[0] : used[0] + len(flat)] = flat
            starts[self.n : self.n + units] = used[0] + np.cumsum(lengths) - lengths
            sizes[self.n : self.n + units] = lengths
            used[0] += len(flat)
            self.columns[name] = [values, starts, sizes, used]
        self.n += units

    def sizes(self, name: str, slots: np.ndarray) -> np.ndarray:
        """How many values of a column each slot has."""
        return self.columns[name][2][slots] if len(slots) else np.empty(0, np.int64)

    def gathered(self, name: str, slots: np.ndarray) -> np.ndarray:
        """The values of a column for all slots, one after another."""
        if not len(slots):
            return np.empty(0, np.int64)
        values, starts, sizes, _ = self.columns[name]
        lengths = sizes[slots]
        total = np.cumsum(lengths)
        return values[np.repeat(starts[slots] - total + lengths, lengths) + np.arange(total[-1])]

    def forget(self) -> None:
        """Drop what lies over the bound."""
        if self.n > self.max_units:
            self.n = self.max_units
            for _, starts, sizes, used in self.columns.values():
                used[0] = starts[self.n - 1] + sizes[self.n - 1] if self.n else 0
