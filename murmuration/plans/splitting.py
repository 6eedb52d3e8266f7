"""Queries of multinomial counts by splitting, and SQL that goes down the same tree."""

from __future__ import annotations

from ..functions.rng import Scripted
from ..operators.splitting import BITS, allocated_by_splitting, multinomial_by_splitting
from .kernels import WEIGHED, _w
from .whole_sql import uniform_sql

NOISE = Scripted(29)
#: Rows that are drawn, of the particles and of the sub-filters.
DRAWN, DEALT = 2000, 50_000


def multinomial_split(spark, sf_dir):
    """Counts of event particles among multinomial draws."""
    return multinomial_by_splitting(_w(spark, sf_dir), DRAWN, NOISE).select("id", "cnt").where("cnt > 0")


def split_alloc(spark, sf_dir):
    """Counts of sub-filters among multinomial draws."""
    return allocated_by_splitting(_w(spark, sf_dir), DEALT, NOISE).select("part", "w", "cnt")


def tree_sql(leaves: str, n: int, height: str, told: str) -> str:
    """``leaves`` selects place and w; ``told`` selects from the leaves' counts ``c(place, cnt)``.

    The tree's root is on the level that ``height`` gives of the table of leaves ``v``.
    """
    pmf = "CASE WHEN p <= 0 THEN (CASE WHEN k = 0 THEN 1 ELSE 0 END) WHEN p >= 1 THEN (CASE WHEN k = c THEN 1 ELSE 0 END) ELSE exp(lgamma(c + 1.0::DOUBLE) - lgamma(k + 1.0::DOUBLE) - lgamma(c - k + 1.0::DOUBLE) + k * ln(p) + (c - k) * ln(1 - p)) END"
    return f"""WITH RECURSIVE {WEIGHED}, v AS ({leaves}), h AS (SELECT {height} AS top FROM v),
      s AS (SELECT l AS level, place >> l AS i, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT v.place, v.w, unnest(range(top + 1)) AS l FROM v, h) GROUP BY l, place >> l),
      r(level, i, c) AS (SELECT CAST(top AS BIGINT), CAST(0 AS BIGINT), CAST({n} AS BIGINT) FROM h UNION ALL (
        SELECT level - 1, 2 * i + side, CASE WHEN side = 0 THEN k ELSE c - k END FROM (
          SELECT level, i, c, coalesce(arg_min(k, seat) FILTER (WHERE used > u), any_value(m)) AS k FROM (
            SELECT *, sum({pmf}) OVER (PARTITION BY level, i ORDER BY seat ROWS UNBOUNDED PRECEDING) AS used FROM (
              SELECT *, CASE WHEN k > m THEN 2 * (k - m) - 1 ELSE 2 * (m - k) END AS seat FROM (
                SELECT *, unnest(range(c + 1)) AS k, CAST(least(c, floor((c + 1) * p)) AS BIGINT) AS m FROM (
                  SELECT r.level, r.i, r.c, coalesce(a.w, 0) / b.w AS p, {uniform_sql(NOISE, 'split', '0', 'r.level', 'r.i')} AS u
                  FROM r JOIN s b ON b.level = r.level AND b.i = r.i LEFT JOIN s a ON a.level = r.level - 1 AND a.i = 2 * r.i WHERE r.level > 0 AND r.c > 0))))
          GROUP BY level, i, c), (SELECT unnest([0, 1]) AS side))),
      c AS (SELECT i AS place, c AS cnt FROM r WHERE level = 0 AND c > 0)
      {told}"""


#: Whole parts of the tree, as tasks take them.
_HEIGHT = f"greatest(1, CAST(ceil(CASE WHEN max(place) > 0 THEN floor(log2(max(place))) + 1 ELSE 0 END / {BITS}.0) AS INT)) * {BITS}"

QUERIES = {
    "multinomial_split": (multinomial_split, tree_sql("SELECT id AS place, w FROM p WHERE w > 0", DRAWN, _HEIGHT, "SELECT place AS id, cnt FROM c")),
    "split_alloc": (
        split_alloc,
        tree_sql("SELECT CAST(part AS BIGINT) AS place, sum(w) AS w FROM p GROUP BY part", DEALT, _HEIGHT, "SELECT CAST(v.place AS INT) AS part, CAST(v.w AS BIGINT) AS w, coalesce(c.cnt, 0) AS cnt FROM v LEFT JOIN c ON v.place = c.place"),
    ),
}
