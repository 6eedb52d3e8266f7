"""Many small sets: matrices of series by particles, advanced in numpy inside one Arrow function.

Steps of a series depend on one another and series do not. Where sets are
small a task takes many series at a time, a row of a matrix each, through one
step after another. Formulas, noise and fixed-point weights are those of the
filters that go a row per particle, and give the same numbers. Sets too large
for a matrix row go that way instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise_arrays import arrays_of
from .resample import ONE

#: Particles of the series that are advanced together, which bounds a task's memory.
CELLS = 1 << 18
#: Particles of all steps together whose sets are kept at a time, some 6 MB.
KEPT = 1 << 18
SAID = "array<struct<t:int,mean:double,ess:double,q05:double,q95:double>>"


def log_weights(w: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(w / float(ONE))


def weights(log_w: np.ndarray) -> np.ndarray:
    """Fixed-point weights of each row, shifted by its largest; equal ones where all vanish."""
    clean = np.where(np.isnan(log_w), -np.inf, log_w)
    top = clean.max(axis=1, keepdims=True)
    none = np.isneginf(top)
    with np.errstate(invalid="ignore", over="ignore"):
        w = np.floor(np.exp(clean - np.where(none, 0.0, top)) * ONE + 0.5)
    return np.where(none, ONE, np.where(np.isnan(w), 0, w)).astype(np.int64)


def size(w: np.ndarray) -> np.ndarray:
    """Effective size of each row."""
    d = w.astype(np.float64)
    return d.sum(axis=1) ** 2 / (d * d).sum(axis=1)


def mean(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (w * x).sum(axis=1) / w.sum(axis=1)


def _systematic(at: np.ndarray, n: int, draw) -> np.ndarray:
    return np.clip(np.ceil(at - draw(None)), 0, n)


def _stratified(at: np.ndarray, n: int, draw) -> np.ndarray:
    whole = np.floor(at)
    return np.minimum(n, whole + (at - whole > draw(whole.astype(np.int64))))


#: Resamplers in closed form: how many of n points lie under each running weight, given as a share of n.
BOUNDS = {"systematic": _systematic, "stratified": _stratified}


def picked(w: np.ndarray, n: int, how: str, draw) -> np.ndarray:
    """The particle of each of n points, for each row."""
    c = np.cumsum(w, axis=1)
    bound = BOUNDS[how](float(n) * c / c[:, -1:], n, draw).astype(np.int64)
    counts = np.diff(bound, axis=1, prepend=0)
    return np.repeat(np.tile(np.arange(w.shape[1]), len(w)), counts.ravel()).reshape(len(w), n)


def at_share(ordered: np.ndarray, share: float) -> np.ndarray:
    """A quantile of each sorted row by linear interpolation."""
    place = (ordered.shape[1] - 1) * share
    below = int(place)
    above = ordered[:, below + 1] if below + 1 < ordered.shape[1] else 0.0
    return (below + 1 - place) * ordered[:, below] + (place - below) * above


def band(x: np.ndarray) -> list[np.ndarray]:
    ordered = np.sort(x, axis=1)
    return [at_share(ordered, 0.05), at_share(ordered, 0.95)]


def gridded(x: np.ndarray, grid: float | None) -> np.ndarray:
    return x if grid is None else np.floor(x * grid + 0.5) / grid


class Sets:
    """The sets ``w, x, parent`` of some series, and one step of a filter over those that have it.

    ``parent`` is a particle's place in the weighted set of the step before.
    """

    names = ("w", "x", "parent")

    def __init__(self, model, filter_: str, config, series: np.ndarray):
        self.model, self.config, self.noise = model, config, arrays_of(config.source)
        self.step = {"bootstrap": self.bootstrap, "auxiliary": self.auxiliary}[filter_]
        self.ids = np.arange(config.particles, dtype=np.int64)[None, :]
        self.series = series[:, None]

    def started(self, n: int) -> dict[str, np.ndarray]:
        x = gridded(self.model.init(self.noise.normal("init", 0, self.series, self.ids)), self.config.grid)
        shape = (n, self.config.particles)
        return {"w": np.full(shape, ONE, np.int64), "x": np.broadcast_to(x, shape).copy(), "parent": np.broadcast_to(self.ids, shape).copy()}

    def bootstrap(self, own: dict[str, np.ndarray], series: np.ndarray, t: int, y: np.ndarray, seen: np.ndarray):
        """(set moved and weighed, set to go on with)."""
        model, config, noise = self.model, self.config, self.noise
        w, before, time, y = own["w"], own["x"], float(t) * config.dt, y[:, None]
        z = noise.normal("move", t, series, self.ids)
        after, proposed = model.propagate(before, time, z), model.proposal(before, y, time, z)
        if proposed is not None:
            after = np.where(seen[:, None], proposed, after)
        x = gridded(after, config.grid)
        with np.errstate(over="ignore", invalid="ignore"):
            gain = model.log_likelihood(y, before if config.weight_on == "pre" else x)
            if proposed is not None:
                gain = gain + model.log_transition(x, before, time) - model.log_proposal(x, before, y, time)
        gain = np.where(seen[:, None], gain, 0.0)
        w = weights(log_weights(w) + gain if config.accumulate else gain)
        now = {"w": w, "x": x, "parent": own["parent"]}
        after = {"w": w.copy(), "x": x.copy(), "parent": np.broadcast_to(self.ids, w.shape).copy()}
        poor = np.flatnonzero(size(w) < config.ess_share * w.shape[1]) if config.ess_share is not None else np.arange(len(w))
        if not poor.size:
            return now, after
        chosen = picked(w[poor], config.particles, config.resampler, self._draw(t, series[poor]))
        after["w"][poor], after["parent"][poor] = ONE, chosen
        after["x"][poor] = np.take_along_axis(x[poor], chosen, axis=1)
        return now, after

    def auxiliary(self, own: dict[str, np.ndarray], series: np.ndarray, t: int, y: np.ndarray, seen: np.ndarray):
        """Resampled by weight times the likelihood of the expected next state, moved, and weighed by the ratio; only moved without an observation."""
        model, config = self.model, self.config
        w, x, time, y = own["w"], own["x"], float(t) * config.dt, y[:, None]
        with np.errstate(over="ignore", invalid="ignore"):
            ahead = model.log_likelihood(y, model.mean(x, time))
        chosen = picked(weights(log_weights(w) + ahead), config.particles, config.resampler, self._draw(t, series))
        chosen = np.where(seen[:, None], chosen, self.ids)
        parent = np.take_along_axis(x, chosen, axis=1)
        x = gridded(model.propagate(parent, time, self.noise.normal("move", t, series, self.ids)), config.grid)
        with np.errstate(over="ignore", invalid="ignore"):
            second = weights(model.log_likelihood(y, x) - np.take_along_axis(ahead, chosen, axis=1))
        now = {"w": np.where(seen[:, None], second, w), "x": x, "parent": chosen}
        return now, now

    def _draw(self, t: int, series: np.ndarray, *keys: np.ndarray):
        return lambda i: self.noise.uniform("pick", t, series, *keys, *([] if i is None else [i]))

    @staticmethod
    def told(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        low, high = band(own["x"])
        return {"mean": mean(own["w"], own["x"]), "ess": size(own["w"]), "q05": low, "q95": high}


def block_of(particles: int, steps: int, keep: bool) -> int:
    """How many series are advanced together; fewer where the sets of all their steps are kept."""
    most = CELLS // max(1, particles)
    return max(1, min(most, KEPT // max(1, particles * steps)) if keep else most)


def _matrix(column: pa.Array, kind) -> np.ndarray:
    """A list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _advanced(sets: Sets, known: dict[str, np.ndarray], low: np.ndarray, high: np.ndarray, owner: np.ndarray, t_seen: np.ndarray, y_seen: np.ndarray, keep: bool) -> tuple[dict[str, np.ndarray], pa.Array | None]:
    """All series through their steps: (sets, summaries by series, with the weighted sets themselves where they are kept)."""
    first = int(low.min(initial=1))
    steps = max(0, int(high.max(initial=0)) - first + 1)
    y, has = np.zeros((len(low), steps)), np.zeros((len(low), steps), bool)
    inside = (t_seen >= first) & (t_seen < first + steps)
    y[owner[inside], t_seen[inside] - first] = y_seen[inside]
    has[owner[inside], t_seen[inside] - first] = True
    parts: list[dict[str, np.ndarray]] = []
    for k in range(steps):
        t = first + k
        at = np.flatnonzero((low <= t) & (t <= high))
        if not at.size:
            continue
        now, after = sets.step({c: m[at] for c, m in known.items()}, sets.series[at], t, y[at, k], has[at, k])
        for c, m in known.items():
            m[at] = after[c]
        parts.append({"series": at, "t": np.full(len(at), t, np.int32), **sets.told(now), **({c: now[c] for c in sets.names} if keep else {})})
    if not parts:
        return known, None
    said = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.argsort(said["series"], kind="stable")
    ends = np.concatenate([[0], np.cumsum(np.bincount(said.pop("series"), minlength=len(low)))])
    columns = [pa.array(v[order]) if v.ndim == 1 else pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v[order].ravel())) for v in said.values()]
    return known, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=list(said)))


def advance_with(rows: DataFrame, make, names: tuple[str, ...], kinds: dict[str, type], particles: int, said: str, keep: bool = False) -> DataFrame:
    """``series_id``, the set columns and ``said`` after the steps ``low..high`` of each row of ``series_id, low, high, seen`` and the set.

    ``seen`` is an array of (t, y); a step without an entry has no
    observation. Null set columns stand for a set that has not begun.
    ``make(series)`` gives the :class:`Sets` of an array of series.
    """
    kind = rows.schema["series_id"].dataType.simpleString()
    spark_names = {np.int64: "bigint", np.float64: "double", np.int32: "int"}
    if keep:
        said = said.removesuffix(">>") + "".join(f",{c}:array<{spark_names[kinds[c]]}>" for c in names) + ">>"

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        first, last = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("low", "high"))
        step = block_of(particles, int((last - first).max(initial=0)) + 1, keep)
        for i in range(0, batch.num_rows, step):
            part = batch.slice(i, step)
            column = {n: part.column(k) for k, n in enumerate(part.schema.names)}
            series = column["series_id"].to_numpy(zero_copy_only=False)
            sets = make(series)
            known = sets.started(len(series))
            begun = np.flatnonzero(column[names[0]].is_valid().to_numpy(zero_copy_only=False))
            for c in names if begun.size else ():
                m = _matrix(column[c].take(pa.array(begun)), kinds[c])
                known[c][begun] = m.reshape(len(begun), *known[c].shape[1:])
            seen = column["seen"]
            owner = np.repeat(np.arange(len(series)), np.diff(seen.offsets.to_numpy()))
            flat = seen.flatten()
            t, y = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            low, high = (column[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("low", "high"))
            known, told = _advanced(sets, known, low, high, owner, t.astype(np.int64), y, keep)
            lists = []
            for c in names:
                flat = known[c].reshape(len(series), -1)
                lists.append(pa.ListArray.from_arrays(pa.array(np.arange(len(series) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel())))
            told = pa.array([[]] * len(series)) if told is None else told
            yield pa.RecordBatch.from_arrays([column["series_id"], *lists, told], names=["series_id", *names, "said"])

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from blocks(batch)

    schema = f"series_id {kind}, {', '.join(f'{c} array<{spark_names[kinds[c]]}>' for c in names)}, said {said}"
    return rows.select("series_id", "low", "high", "seen", *names).mapInArrow(run, schema)


KINDS = {"w": np.int64, "x": np.float64, "parent": np.int64}


def advanced(rows: DataFrame, model, filter_: str, config, keep: bool = False) -> DataFrame:
    """The bootstrap and auxiliary filters by :func:`advance_with`; with ``keep``, ``said`` holds each step's weighted set too."""
    return advance_with(rows, lambda series: Sets(model, filter_, config, series), Sets.names, KINDS, config.particles, SAID, keep)


def nothing() -> list[Column]:
    """The columns of sets that have not begun."""
    return [F.lit(None).cast(f"array<{kind}>").alias(c) for c, kind in (("w", "bigint"), ("x", "double"), ("parent", "bigint"))]


def observed(seen: DataFrame) -> DataFrame:
    """``series_id, seen, first, last``: the observations of a bounded range of steps, an array per series; of a repeated step the least y."""
    once = seen.groupBy("series_id", "t").agg(F.min("y").alias("y"))
    pair = F.struct(F.col("t").cast("int").alias("t"), "y")
    return once.groupBy("series_id").agg(F.collect_list(pair).alias("seen"), F.min("t").cast("int").alias("first"), F.max("t").cast("int").alias("last"))
