"""Registered queries of the near-duplicate operator (1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .lsh_forest import near_duplicates


def op1_minhash_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2, threshold=0.8)


QUERIES = {f.__name__: f for f in (op1_minhash_lsh_forest,)}
_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SQL = rf"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
each AS (SELECT doc_id, CASE WHEN len(w) = 1 THEN w ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END AS g FROM words),
sets AS (SELECT DISTINCT doc_id, unnest(g) AS g FROM each),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sets a JOIN sets b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
least_of AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id, d.doc_id = l.component_id AS kept
FROM documents d JOIN least_of l ON d.doc_id = l.doc_id LEFT JOIN sizes s ON d.doc_id = s.doc_id
"""

ORACLES: dict[str, str] = {"op1_minhash_lsh_forest": _SQL}
