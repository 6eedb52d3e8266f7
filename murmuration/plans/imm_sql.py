"""SQL that repeats the interacting-multiple-model filter on scripted noise: prior, moments, root, both stages."""

from __future__ import annotations

import math

from ..functions import rng
from ..operators.filters import FilterConfig
from ..operators.models import SHIFTS
from ..operators.packed_imm import PAIRS
from .kernels import ROOT_2PI
from .whole_sql import _OBSERVED, ONE, _bound, _grid, _log, _weight, hashed_sql, normal_sql, uniform_sql

P = range(9)
THETA = [f"p{k}" for k in P]


def _d(x: float) -> str:
    return f"{x!r}::DOUBLE"


def _pdf(y: str, x: str) -> str:
    z = f"(({y} - {x}) / 1.0::DOUBLE)"
    return f"(-0.5::DOUBLE * {z} * {z} - ln({ROOT_2PI} * 1.0::DOUBLE))"


def _ln(x: str) -> str:
    """The logarithm of a probability, minus infinity at 0."""
    return f"(CASE WHEN {x} > 0 THEN ln({x}) ELSE '-infinity'::DOUBLE END)"


def _polynomial(coefficients, x: str) -> str:
    out = _d(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * {x} + {_d(c)})"
    return out


def _probit(p: str, tail: str, far: str, q: str) -> str:
    """Inverse normal distribution of p, with the smaller tail, its root of logarithms and p less a half as columns."""
    outside = f"{_polynomial(rng._TAIL, far)} / {_polynomial(rng._TAIL_BELOW, far)}"
    middle = f"{q} * {_polynomial(rng._MIDDLE, f'({q} * {q})')} / {_polynomial(rng._MIDDLE_BELOW, f'({q} * {q})')}"
    return f"CASE WHEN {tail} >= {_d(rng._TAIL_FROM)} THEN {middle} WHEN {p} < 0.5 THEN {outside} ELSE -({outside}) END"


def prior_sql(config: FilterConfig) -> str:
    """``s, id, t, w, r, vol, q, p0..p8`` of step 0, for the series of ``ends``."""
    noise, n, g = config.source, config.particles, config.grid
    u = lambda name: uniform_sql(noise, name, "0", "s", "id")
    below = 0.5 * math.erfc(5.0 / math.sqrt(2))
    drawn = [f"{_d(below)} + {_d(1 - 2 * below)} * {u('r')} AS ur", f"list_sort([{', '.join(u(f'vol{k}') for k in range(6))}])[2] AS v", f"{hashed_sql(noise, 'mu', '0', 's', 'id')} AS a"]
    drawn += [f"-(0.2::DOUBLE) * ln({u(f'c{k}a')} * {u(f'c{k}b')}) AS c{k}" for k in range(2)]
    drawn += [f"{_grid(f'1.0::DOUBLE - pow({u("alpha")}, {_d(1 / 9.0)})', g)} AS alpha", f"pow({u('beta')}, {_d(1 / 9.0)}) AS b"]
    drawn += [f"{u(f'p{k}')} - 0.5::DOUBLE AS u{k}" for k in range(5, 9)]
    halves = f"SELECT *, least(ur, 1.0::DOUBLE - ur) AS tail, ur - 0.5::DOUBLE AS uq FROM (SELECT s, id, {', '.join(drawn)} FROM (SELECT s, unnest(range({n})) AS id FROM ends))"
    laplace = lambda k: f"(-sign(u{k}) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs(u{k})) + {_d(SHIFTS[k - 5])})"
    r = f"greatest(-5.0::DOUBLE, least(5.0::DOUBLE, {_probit('ur', 'tail', 'far', 'uq')}))"
    theta = [normal_sql("a"), "least(c0, c1)", "greatest(c0, c1)", "alpha", "(1.0::DOUBLE - alpha) * b", *[laplace(k) for k in range(5, 9)]]
    columns = [f"{_grid(r, g)} AS r", f"{_grid('v', g)} AS vol", "CAST(id % 2 AS INT) AS q", *[f"{_grid(x, g)} AS p{k}" for k, x in enumerate(theta)]]
    return f"SELECT s, id, CAST(0 AS BIGINT) AS t, CAST(0.5::DOUBLE * {ONE} AS BIGINT) AS w, {', '.join(columns)} FROM (SELECT *, sqrt(-2.0::DOUBLE * ln(tail)) AS far FROM ({halves}))"


def _rooted(source: str) -> str:
    """``source`` with the entries l of the triangular root of its covariances c, a column of the root at a time."""
    for j in P:
        dot = lambda i, j=j: " + ".join(["0.0::DOUBLE", *[f"l{i}_{m} * l{j}_{m}" for m in range(j)]])
        rest = f"(c{j}_{j} - ({dot(j)}))"
        source = f"(SELECT *, sqrt(CASE WHEN {rest} > abs(c{j}_{j}) * 1e-12::DOUBLE THEN {rest} ELSE 0.0::DOUBLE END) AS l{j}_{j} FROM {source})"
        under = [f"CASE WHEN l{j}_{j} > 0 THEN (c{i}_{j} - ({dot(i)})) / l{j}_{j} ELSE 0.0::DOUBLE END AS l{i}_{j}" for i in range(j + 1, 9)]
        if under:
            source = f"(SELECT *, {', '.join(under)} FROM {source})"
    return source


def imm_sql(config: FilterConfig) -> str:
    """The filter with an observation at every step, resampled systematically."""
    noise, n, g, shrink = config.source, config.particles, config.grid, config.shrink
    per = [n // 2 + (mode < n % 2) for mode in range(2)]
    joined = "(SELECT r.*, o.y FROM r JOIN ends ON r.s = ends.s AND r.t < ends.e JOIN o ON r.s = o.s AND r.t + 1 = o.t)"
    stays = f"(SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(p5 + p7 * vol)) AS stay0, 1.0::DOUBLE / (1.0::DOUBLE + exp(p6 + p8 * vol)) AS stay1, sum(w) OVER (PARTITION BY s) AS whole FROM {joined})"
    moves = f"(SELECT *, CASE WHEN q = 0 THEN stay0 ELSE 1.0::DOUBLE - stay1 END AS to0, CASE WHEN q = 1 THEN stay1 ELSE 1.0::DOUBLE - stay0 END AS to1 FROM {stays})"
    over = lambda x: f"sum(w * {x}) OVER (PARTITION BY s) / CAST(whole AS DOUBLE)"
    means = [f"{over(f'to{m}')} AS mode{m}" for m in range(2)] + [f"{_grid(over(f'p{k}'), g)} AS m{k}" for k in P]
    middled = f"(SELECT *, {', '.join(means)} FROM {moves})"
    spread = [f"{_grid(f'{_d(1 - shrink**2)} * ({over(f"((p{i} - m{i}) * (p{j} - m{j}))")})', g)} AS c{i}_{j}" for i, j in PAIRS]
    rooted = _rooted(f"(SELECT *, {', '.join(spread)} FROM {middled})")
    shrunk = [f"{_d(shrink)} * p{k} + {_d(1 - shrink)} * m{k} AS s{k}" for k in P]
    keep = ["s", "id", "t", "y", "r", "vol", "mode0", "mode1", *[f"s{k}" for k in P], *[f"l{i}_{j}" for i, j in PAIRS]]
    each = f"(SELECT *, {', '.join(shrunk)}, {_pdf('y', 'p0')} AS ahead, unnest([0, 1]) AS mode FROM {rooted})"
    first = f"(SELECT {', '.join(keep)}, ahead, mode, ahead + {_ln('CASE WHEN mode = 0 THEN to0 ELSE to1 END')} + {_log('w')} AS lw FROM {each})"
    weighed = f"(SELECT *, {_weight('lw', 'top')} AS w FROM (SELECT *, max(lw) OVER (PARTITION BY s, mode) AS top FROM {first}))"
    sums = f"(SELECT *, CAST(sum(w) OVER (PARTITION BY s, mode ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cw, CAST(sum(w) OVER (PARTITION BY s, mode) AS BIGINT) AS tw FROM {weighed})"
    u = uniform_sql(noise, "pick", "t + 1", "s", "mode")
    size = f"(CASE WHEN mode = 0 THEN {per[0]} ELSE {per[1]} END)"
    bounded = f"(SELECT *, {_bound('(cw - w)', size, u)} AS lo, {_bound('cw', size, u)} AS hi FROM {sums})"
    chosen = f"(SELECT * REPLACE (place * 2 + mode AS id) FROM (SELECT *, unnest(range(lo, hi)) AS place FROM {bounded}))"
    hashes = f"(SELECT *, {', '.join(f'{hashed_sql(noise, f"theta{k}", "t + 1", "s", "id")} AS a{k}' for k in P)}, {hashed_sql(noise, 'move', 't + 1', 's', 'id')} AS am FROM {chosen})"
    noisy = f"(SELECT *, {', '.join(f'{normal_sql(f"a{k}")} AS z{k}' for k in P)}, {normal_sql('am')} AS zm FROM {hashes})"
    steps = [" + ".join(["0.0::DOUBLE", *[f"l{i}_{j} * z{j}" for j in range(i + 1)]]) for i in P]
    drawn = f"(SELECT *, {', '.join(f'{_grid(f"s{k} + ({steps[k]})", g)} AS d{k}' for k in P)} FROM {noisy})"
    free = f"(SELECT *, d0 AS p0, greatest(d1, 0.0::DOUBLE) AS p1, greatest(d2, 0.0::DOUBLE) AS p2, greatest(d3, 0.0::DOUBLE) AS p3, d5 AS p5, d6 AS p6, d7 AS p7, d8 AS p8 FROM {drawn})"
    held = f"(SELECT *, CASE WHEN p3 + d4 > 1 THEN 1.0::DOUBLE - p3 ELSE d4 END AS p4 FROM {free})"
    after = "greatest(CASE WHEN mode = 0 THEN p1 ELSE p2 END + p3 * (r - p0) * (r - p0) + p4 * vol, 0.0::DOUBLE)"
    moved = f"(SELECT * REPLACE ({_grid('p0 + sqrt(after) * zm', g)} AS r, {_grid('after', g)} AS vol) FROM (SELECT *, {after} AS after FROM {held}))"
    second = f"(SELECT *, {_ln('CASE WHEN mode = 0 THEN mode0 ELSE mode1 END')} + {_pdf('y', 'r')} - ahead AS lw2 FROM {moved})"
    topped = f"(SELECT *, max(lw2) OVER (PARTITION BY s) AS top2 FROM {second})"
    step = f"SELECT s, id, t + 1 AS t, {_weight('lw2', 'top2')} AS w, r, vol, CAST(mode AS INT) AS q, {', '.join(THETA)} FROM {topped}"
    told = lambda x, name: f"round(sum(w * {x}) / CAST(sum(w) AS DOUBLE), 6) AS {name}"
    said = [told("r", "mean"), told("vol", "vol"), "round(sum(CAST(w AS DOUBLE)) * sum(CAST(w AS DOUBLE)) / sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)), 6) AS ess", told("CASE WHEN q = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END", "prob_mode0")]
    said += [f"round(quantile_cont(r, {share}), 6) AS {name}" for share, name in ((0.05, "q05"), (0.95, "q95"))] + [told(f"p{k}", f"p{k}") for k in P]
    return f"""WITH RECURSIVE {_OBSERVED},
      r AS ({prior_sql(config)} UNION ALL ({step}))
      SELECT s AS series_id, CAST(t AS INT) AS t, {', '.join(said)} FROM r WHERE t > 0 GROUP BY s, t"""


def imm_prior_sql(config: FilterConfig) -> str:
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in ("r", "vol", *THETA))
    return f"WITH {_OBSERVED} SELECT s AS series_id, id, w, q, {rounded} FROM ({prior_sql(config)})"
