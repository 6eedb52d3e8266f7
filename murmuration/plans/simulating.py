"""Queries of long simulated series, and SQL that walks them step by step."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.rng import Scripted
from ..operators.models import BenchmarkModel, constrained
from ..sources.stretches import long_garch, long_series
from ..sources.tables import table
from .kernels import _STAY0, _STAY1, MEAN, ROOT_10, _garch_rows, _garch_sql, p
from .whole_sql import _grid, hashed_sql, normal_sql, uniform_sql

NOISE, GRID = Scripted(17), float(1 << 20)
#: Steps of the suppliers' and of the orders' series.
LONG, SHORT = 1000, 12


def _rounded(*names):
    """To five places, without a negative zero."""
    return [(F.round(c, 5) + 0.0).alias(c) for c in names]


def simulate_long(spark, sf_dir):
    """A series of the benchmark model for each supplier, from its balance."""
    starts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("series_id"), (F.col("s_acctbal").cast("double") / 1000.0).alias("x"))
    said = long_series(starts, BenchmarkModel(), LONG, NOISE, grid=GRID)
    return said.select("series_id", "t", *_rounded("x", "y"))


def _normal(name: str, t: str) -> str:
    return normal_sql(hashed_sql(NOISE, name, t, "s"))


_LONG = f"""WITH RECURSIVE r(s, t, x) AS (
    SELECT CAST(s_suppkey AS BIGINT), CAST(0 AS BIGINT), CAST(s_acctbal AS DOUBLE) / 1000.0::DOUBLE FROM supplier UNION ALL
    SELECT s, t + 1, {_grid(f"{MEAN.format(x='x', t='(t + 1)::DOUBLE')} + {normal_sql('a')} * {ROOT_10}", GRID)} FROM (SELECT *, {hashed_sql(NOISE, 'move', 't + 1', 's')} AS a FROM r WHERE t < {LONG}))
  SELECT s AS series_id, CAST(t AS INT) AS t, round(x, 5) + 0.0::DOUBLE AS x, round(x * x / 20 + {_normal('observe', 't')}, 5) + 0.0::DOUBLE AS y FROM r WHERE t > 0"""


def simulate_garch(spark, sf_dir):
    """A regime-switching series for each order, from its scripted state and parameters within their ranges."""
    rows = _garch_rows(spark, sf_dir).withColumn("series_id", F.col("id").cast("long"))
    starts = rows.select("series_id", "r", "vol", "q", "p0", *constrained(p(3), p(4), p(1), p(2)), *[f"p{k}" for k in range(5, 9)])
    said = long_garch(starts, SHORT, NOISE, GRID)
    return said.select("series_id", "t", "q", *_rounded("r", "vol", "y"))


_GARCH = f"""WITH RECURSIVE {_garch_sql()},
  c AS (SELECT id AS s, q, r, vol, p0, greatest(p1, 0) AS p1, greatest(p2, 0) AS p2, greatest(p3, 0) AS p3, CASE WHEN greatest(p3, 0) + p4 > 1 THEN 1.0::DOUBLE - greatest(p3, 0) ELSE p4 END AS p4, p5, p6, p7, p8 FROM g),
  w(s, t, q, r, vol) AS (SELECT CAST(s AS BIGINT), CAST(0 AS BIGINT), q, CAST(r AS DOUBLE), CAST(vol AS DOUBLE) FROM c UNION ALL
    SELECT s, t + 1, q, {_grid(f"p0 + sqrt(vol) * {normal_sql('a')}", GRID)}, vol FROM (
      SELECT s, t, q, p0, a, {_grid("CASE WHEN q = 0 THEN p1 ELSE p2 END + p3 * (r - p0) * (r - p0) + p4 * vol", GRID)} AS vol FROM (
        SELECT w.s, t, w.r, w.vol, p0, p1, p2, p3, p4, {hashed_sql(NOISE, 'move', 't + 1', 'w.s')} AS a,
          CASE WHEN {uniform_sql(NOISE, 'mode', 't + 1', 'w.s')} < CASE WHEN w.q = 0 THEN {_STAY0.replace('vol', 'w.vol')} ELSE {_STAY1.replace('vol', 'w.vol')} END THEN w.q ELSE 1 - w.q END AS q
        FROM w JOIN c ON w.s = c.s WHERE t < {SHORT})))
  SELECT s AS series_id, CAST(t AS INT) AS t, q, round(r, 5) + 0.0::DOUBLE AS r, round(vol, 5) + 0.0::DOUBLE AS vol, round(r + {_normal('observe', 't')}, 5) + 0.0::DOUBLE AS y FROM w WHERE t > 0"""

QUERIES = {"simulate_long": (simulate_long, _LONG), "simulate_garch": (simulate_garch, _GARCH)}
