"""State-space models whose formulas serve Spark Columns and numpy arrays alike.

A model says how a row's state moves and how an observation weighs it. Noise
comes in as an argument, so the same expressions serve keyed random numbers
and deterministic checks.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import rng
from ..functions.density import log_normal_pdf, normal_pdf
from ..functions.elementwise import cos, exp, greatest, log, sqrt, where
from .resample import on_grid

ROOT_10 = math.sqrt(10.0)
#: What is added to the Laplace draws of p5 to p8.
SHIFTS = (0.0, -10.0, -5.0, 10.0)


@dataclass(frozen=True)
class ModelSpec:
    """Which parts a state has: continuous x always, a mode q, unknown parameters."""

    has_q: bool = False
    has_theta: bool = False

    def schema(self) -> str:
        state = "r double, vol double, q int" if self.has_q else "x double"
        theta = "".join(f", p{k} double" for k in range(9)) if self.has_theta else ""
        return f"series_id long, id long, part int, w double, {state}{theta}"


class Model(ABC):
    """The scalar interface. ``proposal`` is an optional hook; a filter that has one weighs by likelihood * transition / proposal.

    Formulas made of operators and :mod:`..functions.elementwise` serve small
    sets, which are numpy arrays, and large ones, which are rows. A model that
    can do with Columns only says so by ``columns_only``.
    """

    spec = ModelSpec()
    columns_only = False

    @abstractmethod
    def init(self, z: Column) -> Column: ...

    @abstractmethod
    def mean(self, x: Column, t) -> Column:
        """Expected next state."""

    @abstractmethod
    def propagate(self, x: Column, t, z: Column) -> Column: ...

    @abstractmethod
    def observe(self, x: Column, z: Column) -> Column: ...

    @abstractmethod
    def transition_pdf(self, x: Column, before: Column, t) -> Column: ...

    @abstractmethod
    def likelihood(self, y, x: Column) -> Column: ...

    @abstractmethod
    def log_likelihood(self, y, x: Column) -> Column: ...

    def log_transition(self, x: Column, before: Column, t) -> Column:
        return log(self.transition_pdf(x, before, t))

    def proposal(self, x: Column, y, t, z: Column) -> Column | None:
        return None

    def proposal_pdf(self, x: Column, before: Column, y, t) -> Column | None:
        return None

    def log_proposal(self, x: Column, before: Column, y, t) -> Column:
        return log(self.proposal_pdf(x, before, y, t))


class BenchmarkModel(Model):
    """x' = x/2 + 25x/(1+x^2) + 8cos(1.2t) + sqrt(10) e, y = x^2/20 + e."""

    shift = 0.0
    #: Steps by which the density's cosine lags behind the move's.
    density_lag = 0

    def init(self, z):
        return z * ROOT_10

    def _mean(self, x, t):
        return (x - self.shift) / 2 + 25 * x / (1 + x * x) + 8 * cos(1.2 * t)

    def mean(self, x, t):
        """In closed form: the integral of x times a normal density is its mean."""
        return self._mean(x, t - self.density_lag)

    def propagate(self, x, t, z):
        return self._mean(x, t) + z * ROOT_10

    def observe(self, x, z):
        return x * x / 20 + z

    def transition_pdf(self, x, before, t):
        return normal_pdf(x, self.mean(before, t), ROOT_10)

    def likelihood(self, y, x):
        return normal_pdf(y, x * x / 20, 1.0)

    def log_likelihood(self, y, x):
        return log_normal_pdf(y, x * x / 20, 1.0)


class GrowthModel(BenchmarkModel):
    """The variant with (x-1)/2; its density and prediction use cos(1.2(t-1)) unless ``density_lag`` says otherwise."""

    shift = 1.0

    def __init__(self, density_lag: int = 1):
        self.density_lag = density_lag


class GuidedGrowthModel(GrowthModel):
    """The growth variant whose particles move by the observation, too.

    The observation is linearised about the expected state m, where it has
    the slope m/10. The proposal is the normal distribution of the next state
    given y under that line. Densities are taken at the move's own phase, so
    the weights are those of the model and not of the linearised one.
    """

    def __init__(self):
        super().__init__(density_lag=0)

    def pulled(self, before, y, t):
        """Mean and standard deviation of the next state given y."""
        m = self.mean(before, t)
        slope = m / 10
        variance = 10 / (1 + 10 * slope * slope)
        return m + variance * slope * (y - m * m / 20), sqrt(variance)

    def log_transition(self, x, before, t):
        return log_normal_pdf(x, self.mean(before, t), ROOT_10)

    def proposal(self, x, y, t, z):
        mean, sd = self.pulled(x, y, t)
        return mean + sd * z

    def proposal_pdf(self, x, before, y, t):
        return normal_pdf(x, *self.pulled(before, y, t))

    def log_proposal(self, x, before, y, t):
        return log_normal_pdf(x, *self.pulled(before, y, t))


class RsGarch:
    """Return r, volatility vol and mode q under parameters p0..p8.

    p0 mean; p1, p2 the base volatility of modes 0 and 1; p3, p4 the weights
    of the squared shock and of the last volatility; (p5, p7) govern staying
    in mode 0 and (p6, p8) in mode 1. With ``theta`` these are known and the
    same for every particle; without, each has its own from the prior.
    """

    columns_only = False
    modes = 2

    def __init__(self, theta: Sequence[float] | None = None):
        if theta is not None and len(theta) != 9:
            raise ValueError("theta has nine parameters")
        self.theta = None if theta is None else tuple(map(float, theta))
        self.spec = ModelSpec(has_q=True, has_theta=theta is None)

    @staticmethod
    def init_state(*keys, seed: int = 0, source=None, grid: float | None = None) -> list[Column]:
        """First return and volatility, drawn from ``source``, or by ``seed`` where it is None, on multiples of 1/grid."""
        r = rng.truncated_normal(5.0, *keys, seed=seed, tag="r", source=source)
        vol = rng.beta_2_5(*keys, seed=seed, tag="vol", source=source)
        return [on_grid(r, grid).alias("r"), on_grid(vol, grid).alias("vol")]

    @staticmethod
    def init_mode(p0: float, *keys, seed: int = 0) -> Column:
        return F.when(rng.uniform(*keys, seed=seed, tag="q") < p0, 0).otherwise(1)

    def parameters(self, *keys, seed: int = 0, source=None, grid: float | None = None) -> list[Column]:
        """What is known, or draws from the prior."""
        if self.theta is not None:
            return [F.lit(v).alias(f"p{k}") for k, v in enumerate(self.theta)]
        return self.init_parameters(*keys, seed=seed, source=source, grid=grid)

    @staticmethod
    def init_parameters(*keys, seed: int = 0, source=None, grid: float | None = None) -> list[Column]:
        """The prior; base volatilities in ascending order, p3 + p4 at most 1, on the grid too."""
        c, d = (rng.gamma2(0.2, *keys, seed=seed, tag=f"c{k}", source=source) for k in range(2))
        alpha = on_grid(rng.beta_1(9.0, *keys, seed=seed, tag="alpha", source=source), grid)
        out = [
            rng.normal(*keys, seed=seed, tag="mu") if source is None else source.normal("mu", 0, *keys),
            F.least(c, d),
            F.greatest(c, d),
            alpha,
            rng.beta_to(9.0, 1.0 - alpha, *keys, seed=seed, tag="beta", source=source),
            *[rng.laplace(*keys, seed=seed, tag=f"p{5 + k}", source=source) + shift for k, shift in enumerate(SHIFTS)],
        ]
        return [on_grid(c, grid).alias(f"p{k}") for k, c in enumerate(out)]

    @staticmethod
    def volatility(r: Column, vol: Column, q: Column, p) -> Column:
        base = where(q == 0, p(1), p(2))
        shock = r - p(0)
        return base + p(3) * shock * shock + p(4) * vol

    def propagate(self, r, vol, q, p, z) -> tuple[Column, Column]:
        """The next return and volatility. A negative volatility, as a drawn p4 under 0 can give, counts as 0."""
        after = greatest(self.volatility(r, vol, q, p), 0.0)
        return p(0) + sqrt(after) * z, after

    @staticmethod
    def predict(p) -> Column:
        """Expected return; the volatility to expect is :meth:`volatility`."""
        return p(0)

    @staticmethod
    def stay(q, vol: Column, p) -> Column:
        """Probability to stay in mode q."""
        stay0 = 1.0 / (1.0 + exp(p(5) + p(7) * vol))
        stay1 = 1.0 / (1.0 + exp(p(6) + p(8) * vol))
        if isinstance(q, int):
            return stay0 if q == 0 else stay1
        return where(q == 0, stay0, stay1)

    def mode_probability(self, to, before, vol, p) -> Column:
        stay = self.stay(before, vol, p)
        return where(before == to, stay, 1.0 - stay)

    def next_mode(self, q, vol, p, u) -> Column:
        return where(u < self.stay(q, vol, p), q, 1 - q)

    @staticmethod
    def return_pdf(r: Column, vol: Column, p) -> Column:
        return normal_pdf(r, p(0), sqrt(vol))

    @staticmethod
    def observe(r: Column, z: Column) -> Column:
        return r + z

    @staticmethod
    def likelihood(y, r: Column) -> Column:
        return normal_pdf(y, r, 1.0)

    @staticmethod
    def log_likelihood(y, r: Column) -> Column:
        return log_normal_pdf(y, r, 1.0)


def constrained(p3, p4, p1, p2) -> list:
    """Parameters p1 to p4 pushed back into their ranges: p3 first, then p4 by it, then the base volatilities."""
    alpha = greatest(p3, 0.0)
    out = [greatest(p1, 0.0), greatest(p2, 0.0), alpha, where(alpha + p4 > 1, 1.0 - alpha, p4)]
    return [c.alias(f"p{k + 1}") if isinstance(c, Column) else c for k, c in enumerate(out)]


#: Models by name for :func:`murmuration.operators.filters.run_filter`.
MODELS = {"benchmark": BenchmarkModel, "growth": GrowthModel, "guided": GuidedGrowthModel, "rsgarch": RsGarch}
