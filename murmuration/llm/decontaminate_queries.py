"""Registered query of benchmark decontamination (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import read
from .decontaminate import leaks


def op6_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (op6_simhash_windows,)}
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_GRAMS = "[w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] for i in range(1, len(w) - 3)]"

_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
dg AS (SELECT doc_id, len(w) - 4 AS l, unnest({_GRAMS}) AS g, unnest(range(len(w) - 4)) AS p FROM dw WHERE len(w) >= 5),
iw AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
ig AS (SELECT item_id, len(w) - 4 AS n, unnest({_GRAMS}) AS g FROM iw WHERE len(w) >= 5),
weights AS (SELECT item_id, n, g, count(*) AS c FROM ig GROUP BY ALL),
hits AS (SELECT doc_id, item_id, l, n, least(n, l) AS span, g, c, p FROM dg JOIN weights USING (g)),
placed AS (SELECT doc_id, item_id, n, span, g, c, unnest(range(greatest(0, p - span + 1), least(p, l - span) + 1)) AS first_word FROM hits),
met AS (SELECT doc_id, item_id, n, span, first_word, g, least(count(*), c) AS m FROM placed GROUP BY doc_id, item_id, n, span, first_word, g, c),
windows AS (SELECT doc_id, item_id, first_word, CAST(sum(m) AS DOUBLE) / CAST(n + span - sum(m) AS DOUBLE) AS similarity FROM met GROUP BY doc_id, item_id, n, span, first_word)
SELECT doc_id, item_id, CAST(first_word AS INT) AS first_word, similarity FROM windows WHERE similarity >= 0.8
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, first_word) = 1
"""

ORACLES: dict[str, str] = {"op6_simhash_windows": _SQL}
