"""SQL that repeats whole filter runs on scripted noise, step by step in a recursive query."""

from __future__ import annotations

import math

from ..functions.rng import RANGE, SECOND, SQUARES, Scripted
from ..operators.filters import FilterConfig
from .kernels import ROOT_10, ROOT_2PI

ONE = "4294967296.0::DOUBLE"


def hashed_sql(noise: Scripted, name: str, *keys: str) -> str:
    h = f"CAST({(noise.seed + noise.constant(name)) % RANGE} AS BIGINT)"
    for k in keys:
        h = f"(({h} * 48271 + CAST({k} AS BIGINT)) % {RANGE})"
    for add in SQUARES:
        h = f"(({h} * {h} + {add}) % {RANGE})"
    return h


def uniform_sql(noise: Scripted, name: str, *keys: str) -> str:
    return f"(({hashed_sql(noise, name, *keys)} + 0.5::DOUBLE) / {float(RANGE)}::DOUBLE)"


def normal_sql(a: str) -> str:
    """Of a hashed column."""
    b = f"(({a} * {a} + {SECOND}) % {RANGE})"
    return f"((({a} >> 16) + ({a} & 32767) + ({b} >> 16) + ({b} & 32767) + 2) / 32768.0::DOUBLE - 2.0::DOUBLE) * {math.sqrt(3.0)!r}::DOUBLE"


def _grid(x: str, grid: float) -> str:
    return f"(floor(({x}) * {grid}::DOUBLE + 0.5::DOUBLE) / {grid}::DOUBLE)"


def _mean(x: str, t: str, shift: float) -> str:
    return f"(({x} - {shift}::DOUBLE) / 2 + 25 * {x} / (1 + {x} * {x}) + 8 * cos(1.2::DOUBLE * {t}))"


def _log_pdf(y: str, x: str) -> str:
    z = f"(({y} - {x} * {x} / 20) / 1.0::DOUBLE)"
    return f"(-0.5::DOUBLE * {z} * {z} - ln({ROOT_2PI} * 1.0::DOUBLE))"


def _log(w: str) -> str:
    return f"(CASE WHEN {w} > 0 THEN ln({w} / {ONE}) ELSE '-infinity'::DOUBLE END)"


def _weight(lw: str, top: str) -> str:
    return f"CASE WHEN isfinite({top}) THEN CAST(round(exp({lw} - {top}) * {ONE}) AS BIGINT) ELSE CAST({ONE} AS BIGINT) END"


def _bound(c: str, n: int, u: str) -> str:
    return f"least({n}, greatest(0, CAST(ceil({n}::DOUBLE * CAST({c} AS DOUBLE) / CAST(tw AS DOUBLE) - {u}) AS BIGINT)))"


_OBSERVED = "o AS (SELECT user_id AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 25.0::DOUBLE AS y FROM events), ends AS (SELECT s, max(t) AS e FROM o WHERE y IS NOT NULL GROUP BY s)"


def _sums(source: str) -> str:
    return f"SELECT *, CAST(sum(w) OVER (PARTITION BY s ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cw, CAST(sum(w) OVER (PARTITION BY s) AS BIGINT) AS tw, sum(CAST(w AS DOUBLE)) OVER (PARTITION BY s) AS sd, sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)) OVER (PARTITION BY s) AS sq, count(*) OVER (PARTITION BY s) AS n FROM {source}"


SUMMARY = """SELECT s AS series_id, CAST(t AS INT) AS t, round(sum(w * x) / CAST(sum(w) AS DOUBLE), 6) AS mean,
        round(sum(CAST(w AS DOUBLE)) * sum(CAST(w AS DOUBLE)) / sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)), 6) AS ess,
        round(quantile_cont(x, 0.05), 6) AS q05, round(quantile_cont(x, 0.95), 6) AS q95
      FROM r WHERE t > 0 GROUP BY s, t"""


def _run(config: FilterConfig, step: str, told: str = SUMMARY) -> str:
    noise, n = config.source, config.particles
    start = _grid(f"{normal_sql('a')} * {ROOT_10}", config.grid)
    return f"""WITH RECURSIVE {_OBSERVED},
      i AS (SELECT s, unnest(range({n})) AS id FROM ends),
      z AS (SELECT s, id, {hashed_sql(noise, "init", "0", "s", "id")} AS a FROM i),
      r AS (SELECT s, id, id AS parent, CAST(0 AS BIGINT) AS t, CAST({ONE} AS BIGINT) AS w, {start} AS x FROM z UNION ALL ({step}))
      {told}"""


def _noise(config: FilterConfig, source: str) -> str:
    """``source`` with the next step's noise z; its rows have s, t and id."""
    noise = config.source
    pair = f"SELECT *, {hashed_sql(noise, 'move', 't + 1', 's', 'id')} AS a FROM {source}"
    return f"SELECT *, {normal_sql('a')} AS z FROM ({pair})"


def bootstrap_sql(config: FilterConfig, told: str = SUMMARY) -> str:
    """The bootstrap filter on the benchmark model; ``told`` selects from its sets ``r``."""
    n, time = config.particles, f"(CAST(t + 1 AS DOUBLE) * {config.dt}::DOUBLE)"
    u = uniform_sql(config.source, "pick", "t", "s")
    bounded = f"SELECT *, {_bound('(cw - w)', n, u)} AS lo, {_bound('cw', n, u)} AS hi, sd * sd / sq < {config.ess_share}::DOUBLE * n AS poor FROM ({_sums('r')})"
    spread = f"SELECT s, t, x, id AS parent, unnest(CASE WHEN poor THEN range(lo, hi) ELSE [id] END) AS id, CASE WHEN poor THEN CAST({ONE} AS BIGINT) ELSE w END AS w FROM ({bounded})"
    moved = f"SELECT s, id, parent, t, w, {_grid(f'{_mean("x", time, 0.0)} + z * {ROOT_10}', config.grid)} AS x FROM ({_noise(config, f'({spread})')})"
    gained = f"SELECT m.s, m.id, m.parent, m.t + 1 AS t, m.x, {_log('m.w')} + coalesce({_log_pdf('o.y', 'm.x')}, 0) AS lw FROM ({moved}) m JOIN ends ON m.s = ends.s AND m.t < ends.e LEFT JOIN o ON m.s = o.s AND m.t + 1 = o.t"
    topped = f"SELECT *, max(lw) OVER (PARTITION BY s) AS top FROM ({gained})"
    return _run(config, f"SELECT s, id, parent, t, {_weight('lw', 'top')} AS w, x FROM ({topped})", told)


def _log_normal(x: str, mean: str, sd: str) -> str:
    z = f"(({x} - {mean}) / {sd})"
    return f"(-0.5::DOUBLE * {z} * {z} - ln({ROOT_2PI} * {sd}))"


def guided_sql(config: FilterConfig) -> str:
    """The bootstrap filter on the guided growth model."""
    n, time = config.particles, f"(CAST(b.t + 1 AS DOUBLE) * {config.dt}::DOUBLE)"
    u = uniform_sql(config.source, "pick", "t", "s")
    bounded = f"SELECT *, {_bound('(cw - w)', n, u)} AS lo, {_bound('cw', n, u)} AS hi, sd * sd / sq < {config.ess_share}::DOUBLE * n AS poor FROM ({_sums('r')})"
    spread = f"SELECT s, t, x, id AS parent, unnest(CASE WHEN poor THEN range(lo, hi) ELSE [id] END) AS id, CASE WHEN poor THEN CAST({ONE} AS BIGINT) ELSE w END AS w FROM ({bounded})"
    ahead = f"SELECT b.s, b.id, b.parent, b.t, b.w, b.z, o.y, {_mean('b.x', time, 1.0)} AS m FROM ({_noise(config, f'({spread})')}) b JOIN ends ON b.s = ends.s AND b.t < ends.e LEFT JOIN o ON b.s = o.s AND b.t + 1 = o.t"
    varied = f"SELECT *, 10 / (1 + 10 * (m / 10) * (m / 10)) AS v FROM ({ahead})"
    pulled = f"SELECT *, m + v * (m / 10) * (y - m * m / 20) AS c, sqrt(v) AS d FROM ({varied})"
    moved = f"SELECT *, {_grid(f'CASE WHEN y IS NULL THEN m + z * {ROOT_10} ELSE c + d * z END', config.grid)} AS x FROM ({pulled})"
    gain = f"{_log_pdf('y', 'x')} + {_log_normal('x', 'm', ROOT_10)} - {_log_normal('x', 'c', 'd')}"
    topped = f"SELECT *, max(lw) OVER (PARTITION BY s) AS top FROM (SELECT *, {_log('w')} + coalesce({gain}, 0) AS lw FROM ({moved}))"
    return _run(config, f"SELECT s, id, parent, t + 1 AS t, {_weight('lw', 'top')} AS w, x FROM ({topped})")


def auxiliary_sql(config: FilterConfig) -> str:
    """The auxiliary filter on the growth model, with an observation at every step."""
    n, now, time = config.particles, f"((CAST(t + 1 AS DOUBLE) * {config.dt}::DOUBLE) - 1)", f"(CAST(t + 1 AS DOUBLE) * {config.dt}::DOUBLE)"
    expected = f"SELECT r.s, r.id, r.t, r.w, r.x, o.y, {_mean('r.x', now.replace('t + 1', 'r.t + 1'), 1.0)} AS m FROM r JOIN o ON r.s = o.s AND r.t + 1 = o.t"
    ahead = f"SELECT *, {_log_pdf('y', 'm')} AS ahead FROM ({expected})"
    topped = f"SELECT *, max(lw) OVER (PARTITION BY s) AS top FROM (SELECT *, {_log('w')} + ahead AS lw FROM ({ahead}))"
    first = f"SELECT s, id, t, x, y, ahead, {_weight('lw', 'top')} AS w FROM ({topped})"
    u = uniform_sql(config.source, "pick", "t + 1", "s")
    bounded = f"SELECT *, {_bound('(cw - w)', n, u)} AS lo, {_bound('cw', n, u)} AS hi FROM ({_sums(f'({first})')})"
    spread = f"SELECT s, t, x, y, ahead, id AS parent, unnest(range(lo, hi)) AS id FROM ({bounded})"
    moved = f"SELECT s, id, parent, t, y, ahead, {_grid(f'{_mean("x", time, 1.0)} + z * {ROOT_10}', config.grid)} AS x FROM ({_noise(config, f'({spread})')})"
    again = f"SELECT *, max(lw) OVER (PARTITION BY s) AS top FROM (SELECT *, {_log_pdf('y', 'x')} - ahead AS lw FROM ({moved}))"
    return _run(config, f"SELECT s, id, parent, t + 1 AS t, {_weight('lw', 'top')} AS w, x FROM ({again})")


def stored_ess_sql(config: FilterConfig, t: int) -> str:
    return bootstrap_sql(config, f"SELECT s AS series_id, CAST(t AS INT) AS t, round(sum(CAST(w AS DOUBLE)) * sum(CAST(w AS DOUBLE)) / sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)), 6) AS ess FROM r WHERE t = {t} GROUP BY s, t")


def stored_integral_sql(config: FilterConfig, t: int) -> str:
    return bootstrap_sql(config, f"SELECT s AS series_id, CAST(t AS INT) AS t, round(sum(w * x * x) / CAST(sum(w) AS DOUBLE), 6) AS value FROM r WHERE t = {t} GROUP BY s, t")


def stored_ancestors_sql(config: FilterConfig, t: int, back_to: int) -> str:
    steps = [f"a{t} AS (SELECT s, id, t, id AS ancestor, parent, x FROM r WHERE t = {t})"]
    steps += [f"a{k} AS (SELECT a.s, a.id, r.t, r.id AS ancestor, r.parent, r.x FROM a{k + 1} a JOIN r ON a.s = r.s AND r.t = {k} AND r.id = a.parent)" for k in range(t - 1, back_to - 1, -1)]
    rows = " UNION ALL ".join(f"SELECT * FROM a{k}" for k in range(back_to, t + 1))
    return bootstrap_sql(config, f"SELECT * FROM (WITH {', '.join(steps)} SELECT s AS series_id, id, CAST(t AS INT) AS t, ancestor, round(x, 6) AS x FROM ({rows}))")
