"""SQL that repeats partitioned runs on scripted noise, step by step in a recursive query for each scheme."""

from __future__ import annotations

from ..operators.filters import FilterConfig
from ..operators.schemes import ALLOCATION
from .kernels import ROOT_10
from .whole_sql import ONE, _grid, _log, _log_pdf, _mean, _weight, hashed_sql, normal_sql, uniform_sql

N = "(SELECT count(*) FROM events)"


def _bounds(n: str, u: str, c: str = "cw", w: str = "w", tw: str = "tw") -> str:
    at = "least({n}, greatest(0, CAST(ceil(CAST({n} AS DOUBLE) * CAST({c} AS DOUBLE) / CAST(nullif({tw}, 0) AS DOUBLE) - {u}) AS BIGINT)))"
    return at.format(n=n, c=f"({c} - {w})", u=u, tw=tw) + " AS lo, " + at.format(n=n, c=c, u=u, tw=tw) + " AS hi"


class _Schemes:
    """The schemes as ``SELECT`` of ``id, part, x, t, weight`` from a source with ``id, part, x, t, w``."""

    def __init__(self, config: FilterConfig):
        self.config, self.parts = config, config.parts
        self.share = f"({N} // {self.parts} + CASE WHEN part < {N} % {self.parts} THEN 1 ELSE 0 END)"
        self.even = f"1.0::DOUBLE / {N}"

    def u(self, *keys: str) -> str:
        return uniform_sql(self.config.source, "draw", "t", *keys)

    def by_part(self, source: str, n: str, weight: str) -> str:
        """Each sub-filter by itself to n points; ``weight`` may use the sums wp and wt, the size np and the count nn."""
        sums = f"SELECT *, CAST(sum(w) OVER (PARTITION BY part ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cw, CAST(sum(w) OVER (PARTITION BY part) AS BIGINT) AS wp, CAST(sum(w) OVER () AS BIGINT) AS wt, count(*) OVER (PARTITION BY part) AS np FROM ({source})"
        bounded = f"SELECT *, {_bounds('nn', self.u('part'), tw='wp')} FROM (SELECT *, {n} AS nn FROM ({sums}))"
        return f"SELECT CAST(part AS BIGINT) * 4294967296 + unnest(range(lo, hi)) AS id, part, x, t, {weight} AS weight FROM ({bounded}) WHERE hi > lo"

    def of_parts(self, source: str) -> str:
        """With the sums of sub-filters: their own wq, the running cq, all tq."""
        return f"SELECT *, CAST(sum(w) OVER (PARTITION BY part) AS BIGINT) AS wq, CAST(sum(w) OVER (ORDER BY part RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cq, CAST(sum(w) OVER () AS BIGINT) AS tq FROM ({source})"

    def dealt(self, source: str, n: str) -> str:
        return f"SELECT *, {_bounds(n, self.u(str(ALLOCATION)), 'cq', 'wq', 'tq')} FROM ({self.of_parts(source)})"

    def chosen(self, source: str, extra: int) -> str:
        """Selection and exchange."""
        ranked = f"SELECT *, row_number() OVER (PARTITION BY part ORDER BY id) - 1 AS rn, count(*) OVER (PARTITION BY part) AS np FROM ({source})"
        each = f"SELECT DISTINCT part, np, t FROM ({ranked})"
        targets = f"SELECT *, unnest(range({self.parts})) AS target FROM ({each})"
        draws = f"SELECT *, unnest(range(np // {self.parts} + {extra})) AS j FROM ({targets})"
        at = f"SELECT part, target, j, least(CAST(floor({self.u('part', 'target', 'j')} * np) AS BIGINT), np - 1) AS rn FROM ({draws})"
        return f"SELECT (CAST(d.part AS BIGINT) * {self.parts} + d.target) * 4294967296 + d.j AS id, CAST(d.target AS INT) AS part, k.x, k.t, k.w FROM ({at}) d JOIN ({ranked}) k ON d.part = k.part AND d.rn = k.rn"

    def cen(self, s: str) -> str:
        sums = f"SELECT *, CAST(sum(w) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cw, CAST(sum(w) OVER () AS BIGINT) AS tw FROM ({s})"
        return f"SELECT unnest(range(lo, hi)) AS id, part, x, t, {self.even} AS weight FROM (SELECT *, {_bounds(N, self.u('0'))} FROM ({sums})) WHERE hi > lo"

    def dpf_noshuffle(self, s: str) -> str:
        return self.by_part(s, self.share, self.even)

    def dpf(self, s: str) -> str:
        return self.by_part(self.chosen(s, 0), self.share, self.even)

    def sub(self, s: str) -> str:
        return self.by_part(self.chosen(s, 1), f"{N} // {self.parts}", self.even)

    def dist1(self, s: str) -> str:
        return self.by_part(s, self.share, "CAST(wp AS DOUBLE) / CAST(wt AS DOUBLE) / nn")

    def decen(self, s: str) -> str:
        return self.by_part(s, "np", "CAST(wp AS DOUBLE) / np / CAST(wt AS DOUBLE)")

    def dist2(self, s: str) -> str:
        return self.by_part(f"SELECT id, part, x, t, w, hi - lo AS cnt FROM ({self.dealt(s, N)})", "cnt", self.even)

    def dist3(self, s: str) -> str:
        copies = f"SELECT id, CAST(unnest(range(lo, hi)) AS INT) AS part, x, t, w FROM ({self.dealt(s, str(self.parts))}) WHERE hi > lo"
        return self.by_part(copies, self.share, self.even)

    def hiera(self, s: str) -> str:
        point = f"CAST(floor({self.u('i')} * CAST(q.tq AS DOUBLE)) AS BIGINT)"
        parts = f"SELECT DISTINCT part, wq, cq, tq, t FROM ({self.of_parts(s)})"
        counts = f"SELECT part, count(*) AS cnt FROM ({parts}) q, range({N}) d(i) WHERE {point} >= cq - wq AND {point} < cq GROUP BY part"
        return self.by_part(f"SELECT k.id, k.part, k.x, k.t, k.w, c.cnt FROM ({s}) k JOIN ({counts}) c ON k.part = c.part", "cnt", self.even)


def scheme_sql(config: FilterConfig, scheme: str) -> str:
    """``scheme, t, mean, ess`` of one run of events over the users' mean values."""
    noise = config.source

    def moved(source: str, t: str) -> str:
        """The set of step t, with its log-weights, from ``id, part, x, w``."""
        a = f"SELECT *, {hashed_sql(noise, 'move', t, 'part', 'id')} AS a FROM ({source})"
        x = _grid(f"{_mean('x', f'(CAST({t} AS DOUBLE) * {config.dt}::DOUBLE)', 0.0)} + {normal_sql('a')} * {ROOT_10}", config.grid)
        after = f"SELECT id, part, {t} AS t, w, x AS before, {x} AS x FROM ({a})"
        gain = _log_pdf("o.y", "before" if config.weight_on == "pre" else "m.x")
        return f"SELECT CAST(m.t AS BIGINT) AS t, CAST(m.id AS BIGINT) AS id, CAST(m.part AS INT) AS part, {f'{_log("m.w")} + {gain}' if config.accumulate else gain} AS lw, m.x FROM ({after}) m JOIN o ON o.t = m.t"

    start = f"SELECT event_id AS id, CAST(user_id % {config.parts} AS INT) AS part, value / 25.0::DOUBLE - 10.0::DOUBLE AS x, CAST({ONE} AS BIGINT) AS w FROM events"
    weighed = f"SELECT id, part, x, t, {_weight('lw', 'top')} AS w FROM (SELECT *, max(lw) OVER () AS top FROM r WHERE t < (SELECT max(t) FROM o))"
    after = f"SELECT id, part, x, t, CAST(round(weight * {N} * {ONE}) AS BIGINT) AS w FROM ({getattr(_Schemes(config), scheme)(weighed)})"
    return f"""(WITH RECURSIVE e AS (SELECT row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t, value / 25.0::DOUBLE AS y FROM events),
      o AS MATERIALIZED (SELECT CAST(t AS BIGINT) AS t, avg(y) AS y FROM e GROUP BY t),
      r AS ({moved(start, "1")} UNION ALL ({moved(after, "t + 1")}))
      SELECT '{scheme}' AS scheme, CAST(t AS INT) AS t, round(sum(w * x) / CAST(sum(w) AS DOUBLE), 6) AS mean,
        round(sum(CAST(w AS DOUBLE)) * sum(CAST(w AS DOUBLE)) / sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)), 6) AS ess
      FROM (SELECT *, {_weight('lw', 'top')} AS w FROM (SELECT *, max(lw) OVER (PARTITION BY t) AS top FROM r)) GROUP BY t)"""


def schemes_sql(config: FilterConfig, schemes: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT * FROM {scheme_sql(config, s)}" for s in schemes)
