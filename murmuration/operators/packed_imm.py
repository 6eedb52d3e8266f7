"""The auxiliary interacting-multiple-model filter over small sets, matrices of series by particles.

A set is ``w, r, vol, q, p``, p nine parameters of each particle. The steps
are those of :func:`.filters.imm_step` with the same noise.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.noise_arrays import arrays_of
from .models import RsGarch, constrained
from .packed import advance_with, band, gridded, log_weights, mean, picked, size, weights
from .resample import ONE

PARAMETERS = 9
PAIRS = [(i, j) for i in range(PARAMETERS) for j in range(i + 1)]
SAID = "array<struct<t:int,mean:double,vol:double,ess:double,prob_mode0:double,q05:double,q95:double,p:array<double>>>"
KINDS = {"w": np.int64, "r": np.float64, "vol": np.float64, "q": np.int32, "p": np.float64}


def root_of(covariances: Column) -> Column:
    """Lower triangle of a root of a covariance given as its lower triangle, both by rows.

    Cholesky's recursion as a fold. A direction without variance, or with less
    than rounding leaves of it, has a column of zeros, so a singular covariance
    has a root too.
    """

    def entry(done, k, row, column):
        base, other = ((n * (n + 1) / 2).cast("int") for n in (row, column))
        left = F.slice(done, base + 1, column)
        right = F.when(row == column, left).otherwise(F.slice(done, other + 1, column))
        dot = F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        rest = F.get(covariances, k) - dot
        pivot = F.get(done, other + column)
        small = F.abs(F.get(covariances, k)) * 1e-12
        return F.when(row == column, F.sqrt(F.when(rest > small, rest).otherwise(0.0))).when(pivot > 0, rest / pivot).otherwise(0.0)

    places = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(PAIRS)])
    return F.aggregate(places, F.array().cast("array<double>"), lambda done, at: F.concat(done, F.array(entry(done, at["k"], at["i"], at["j"]))))


def root_arrays(covariances: np.ndarray) -> np.ndarray:
    """:func:`root_of` for each row of an array."""
    done = np.zeros_like(covariances)
    place = {pair: k for k, pair in enumerate(PAIRS)}
    for k, (i, j) in enumerate(PAIRS):
        rest = covariances[:, k] - sum((done[:, place[i, m]] * done[:, place[j, m]] for m in range(j)), np.zeros(len(done)))
        if i == j:
            done[:, k] = np.sqrt(np.where(rest > np.abs(covariances[:, k]) * 1e-12, rest, 0.0))
        else:
            pivot = done[:, place[j, j]]
            done[:, k] = np.divide(rest, pivot, out=np.zeros_like(rest), where=pivot > 0)
    return done


class ImmSets:
    """The sets of some series, and one step of the filter over those that have it."""

    names = tuple(KINDS)
    model = RsGarch()

    def __init__(self, config, series: np.ndarray):
        self.config, self.noise = config, arrays_of(config.source)
        self.ids = np.arange(config.particles, dtype=np.int64)[None, :]
        self.series = series[:, None]

    def started(self, n: int) -> dict[str, np.ndarray]:
        """Room for sets that rows bring with them."""
        shape = (n, self.config.particles)
        return {c: np.zeros((*shape, PARAMETERS) if c == "p" else shape, kind) for c, kind in KINDS.items()}

    def step(self, own: dict[str, np.ndarray], series: np.ndarray, t: int, y: np.ndarray, seen: np.ndarray):
        after = {c: np.empty_like(m) for c, m in own.items()}
        for some, move in ((np.flatnonzero(seen), self.watched), (np.flatnonzero(~seen), self.idle)):
            if some.size:
                for c, m in move({k: v[some] for k, v in own.items()}, series[some], t, y[some]).items():
                    after[c][some] = m
        return after, after

    def moments(self, own: dict[str, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(probabilities of the next modes, parameter means, root of their covariance by the shrinkage's rest)."""
        w, p = own["w"], own["p"]
        modes = [mean(w, self.model.mode_probability(i, own["q"], own["vol"], lambda k: p[:, :, k])) for i in range(self.model.modes)]
        grid = self.config.grid
        middle = gridded(np.stack([mean(w, p[:, :, k]) for k in range(PARAMETERS)], axis=1), grid)
        away = p - middle[:, None, :]
        covariances = np.stack([(1 - self.config.shrink**2) * mean(w, away[:, :, i] * away[:, :, j]) for i, j in PAIRS], axis=1)
        return modes, middle, root_arrays(gridded(covariances, grid))

    def watched(self, own: dict[str, np.ndarray], series: np.ndarray, t: int, y: np.ndarray) -> dict[str, np.ndarray]:
        """Sets after a step with an observation."""
        model, config, noise, y = self.model, self.config, self.noise, y[:, None]
        p, place = own["p"], {pair: k for k, pair in enumerate(PAIRS)}
        modes, middle, root = self.moments(own)
        shrunk = config.shrink * p + (1 - config.shrink) * middle[:, None, :]
        ahead = model.log_likelihood(y, model.predict(lambda k: p[:, :, k]))
        out = {c: np.empty_like(m) for c, m in own.items()}
        log_w = np.empty(own["w"].shape)
        for mode in range(model.modes):
            n = config.particles // model.modes + (mode < config.particles % model.modes)
            with np.errstate(divide="ignore"):
                to_mode = np.log(model.mode_probability(mode, own["q"], own["vol"], lambda k: p[:, :, k]))
                share = np.log(modes[mode])[:, None]
            first = weights(ahead + to_mode + log_weights(own["w"]))
            key = np.full((1, 1), mode, np.int32)
            chosen = picked(first, n, config.resampler, lambda i, key=key: noise.uniform("pick", t, series, key, *([] if i is None else [i])))
            ids = self.ids[:, mode :: model.modes][:, :n]
            z = [noise.normal(f"theta{k}", t, series, ids) for k in range(PARAMETERS)]
            base = np.take_along_axis(shrunk, chosen[:, :, None], axis=1)
            d = [base[:, :, k] + sum((root[:, place[k, j], None] * z[j] for j in range(k + 1)), 0.0) for k in range(PARAMETERS)]
            d = [gridded(x, config.grid) for x in d]
            p1, p2, p3, p4 = constrained(d[3], d[4], d[1], d[2])
            theta = np.stack([d[0], p1, p2, p3, p4, *d[5:]], axis=2)
            r, vol = model.propagate(*(np.take_along_axis(own[c], chosen, axis=1) for c in ("r", "vol")), np.full(chosen.shape, mode, np.int32), lambda k, theta=theta: theta[:, :, k], noise.normal("move", t, series, ids))
            r, vol = gridded(r, config.grid), gridded(vol, config.grid)
            here = np.s_[:, mode :: model.modes]
            out["r"][here], out["vol"][here], out["q"][here], out["p"][here] = r, vol, mode, theta
            log_w[here] = share + model.log_likelihood(y, r) - np.take_along_axis(ahead, chosen, axis=1)
        out["w"] = weights(log_w)
        return out

    def idle(self, own: dict[str, np.ndarray], series: np.ndarray, t: int, y: np.ndarray) -> dict[str, np.ndarray]:
        """Without an observation a particle draws its next mode and keeps weight and parameters."""
        p = lambda k: own["p"][:, :, k]
        q = self.model.next_mode(own["q"], own["vol"], p, self.noise.uniform("mode", t, series, self.ids))
        r, vol = self.model.propagate(own["r"], own["vol"], q, p, self.noise.normal("move", t, series, self.ids))
        return {**own, "q": q, "r": gridded(r, self.config.grid), "vol": gridded(vol, self.config.grid)}

    @staticmethod
    def told(own: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        w, (low, high) = own["w"], band(own["r"])
        p = np.stack([mean(w, own["p"][:, :, k]) for k in range(PARAMETERS)], axis=1)
        return {"mean": mean(w, own["r"]), "vol": mean(w, own["vol"]), "ess": size(w), "prob_mode0": mean(w, own["q"] == 0), "q05": low, "q95": high, "p": p}


class HybridSets(ImmSets):
    """The same sets under the bootstrap filter: modes, states and weights move, parameters stay with their particle."""

    def step(self, own: dict[str, np.ndarray], series: np.ndarray, t: int, y: np.ndarray, seen: np.ndarray):
        config = self.config
        now = self.idle(own, series, t, y)
        gain = np.where(seen[:, None], self.model.log_likelihood(y[:, None], now["r"]), 0.0)
        now["w"] = weights(log_weights(own["w"]) + gain if config.accumulate else gain)
        share = config.ess_share
        poor = np.arange(len(y)) if share is None else np.flatnonzero(size(now["w"]) < share * config.particles)
        after = {c: m.copy() for c, m in now.items()}
        if poor.size:
            chosen = picked(now["w"][poor], config.particles, config.resampler, lambda i: self.noise.uniform("pick", t, series[poor], *([] if i is None else [i])))
            for c, m in now.items():
                after[c][poor] = np.take_along_axis(m[poor], chosen[:, :, None] if c == "p" else chosen, axis=1)
            after["w"][poor] = ONE
        return now, after


def started(config, model: RsGarch, p0: float = 0.5) -> list[Column]:
    """A series' first set as columns, as :func:`.filters.imm_initial` has it."""
    ids = F.sequence(F.lit(0).cast("long"), F.lit(config.particles - 1).cast("long"))
    q = lambda i: (i % model.modes).cast("int")
    weight = lambda i: F.round(F.when(q(i) == 0, p0).otherwise(1 - p0) * ONE).cast("long")
    state = F.transform(ids, lambda i: F.struct(*[c.alias(n) for n, c in zip(("r", "vol"), model.init_state("series_id", i, source=config.source, grid=config.grid), strict=True)]))
    theta = F.flatten(F.transform(ids, lambda i: F.array(*model.parameters("series_id", i, source=config.source, grid=config.grid))))
    return [F.transform(ids, weight).alias("w"), F.transform(state, lambda s: s["r"]).alias("r"), F.transform(state, lambda s: s["vol"]).alias("vol"), F.transform(ids, q).alias("q"), theta.alias("p")]


def advanced(rows: DataFrame, config, kind: type[ImmSets] = ImmSets) -> DataFrame:
    """The filter by :func:`.packed.advance_with`; ``kind`` says which."""
    return advance_with(rows, lambda series: kind(config, series), kind.names, KINDS, config.particles * PARAMETERS, SAID)
