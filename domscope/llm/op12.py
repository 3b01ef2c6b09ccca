"""The query op12_divergence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .divergence import divergences


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per language and source: how far it is from each other source, and the terms that it uses most beyond its language."""
    return divergences(table(spark, sf_dir, "documents"), min_docs=10, top=10)


#: Every kept term for every group, also where its count is 0.
ORACLE = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
w AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(ws) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term, sum(n) AS n FROM w GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, term, sum(w.n) AS n FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
p AS MATERIALIZED (
  SELECT lang, source, term, n, CAST(1 + 1000000000 * (n + 2) // (sum(n) OVER s + 2 * count(*) OVER s) AS BIGINT) AS p
  FROM (SELECT g.lang, g.source, k.term, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term)
  WINDOW s AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, CAST(1 + 1000000000 * (CAST(n AS BIGINT) + 2) // (sum(n) OVER s + 2 * count(*) OVER s) AS BIGINT) AS q FROM k WINDOW s AS (PARTITION BY lang)),
f AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS BIGINT) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
both_parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER x AS INTEGER) AS rank FROM both_parts
WINDOW x AS (PARTITION BY lang, source, part ORDER BY value DESC, item) QUALIFY part = 'pair' OR rank <= 10
"""
