"""Registered query of line dedup (5), and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .line_dedup import dedup_lines


def op5_line_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(read(spark, sf_dir, "documents")).select("doc_id", "text", "n_removed")


QUERIES = {f.__name__: f for f in (op5_line_windows,)}

_SQL = r"""
WITH lines AS (
  SELECT doc_id, text,
         string_split(regexp_replace(coalesce(text, ''), '([^ \n\t\r]{9}[ \n\t\r]|[.!?,;:][ \n\t\r]|\n)', '\1' || chr(31), 'g'), chr(31)) AS u
  FROM documents),
each AS (SELECT doc_id, unnest(u) AS line, unnest(range(len(u))) AS i FROM lines),
trimmed AS (
  SELECT doc_id, i, rtrim(line, chr(32) || chr(10) || chr(9) || chr(13)) AS t FROM each),
three AS (
  SELECT doc_id, i, t AS a, lead(t, 1) OVER w AS b, lead(t, 2) OVER w AS c
  FROM trimmed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS k FROM three WHERE c IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, i + d AS i FROM ranked, (VALUES (0), (1), (2)) AS o(d) WHERE k > 1),
runs AS (
  SELECT c.doc_id, c.i, length(e.line) AS n, c.i - row_number() OVER (PARTITION BY c.doc_id ORDER BY c.i) AS run
  FROM covered c JOIN each e ON c.doc_id = e.doc_id AND c.i = e.i),
gone AS (SELECT doc_id, i FROM runs QUALIFY sum(n) OVER (PARTITION BY doc_id, run) >= 60),
left_over AS (
  SELECT e.doc_id, string_agg(e.line, '' ORDER BY e.i) AS text
  FROM each e ANTI JOIN gone c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY e.doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT l.doc_id,
       CASE WHEN l.text IS NULL THEN NULL ELSE coalesce(o.text, '') END AS text,
       CAST(coalesce(r.n, 0) AS INT) AS n_removed
FROM lines l LEFT JOIN left_over o ON l.doc_id = o.doc_id LEFT JOIN removed r ON l.doc_id = r.doc_id
"""

ORACLES: dict[str, str] = {"op5_line_windows": _SQL}
