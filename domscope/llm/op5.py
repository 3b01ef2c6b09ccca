"""The query op5_line_dedup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .line_dedup import MIN_WORDS, dedup_lines


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text without later copies of runs of lines, its lines before, and those deleted."""
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), MIN_WORDS)


#: Every shortest run of lines with the weight is looked up by its text, joined by line ends.
ORACLE = f"""
WITH l AS (
  SELECT doc_id, pos, line, greatest(len(regexp_extract_all(line, '[^ \t\r]+')), 1) AS w FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents WHERE text IS NOT NULL)),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM l),
runs AS (
  SELECT a.doc_id, a.pos AS s, min(b.pos) AS e FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS} AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY ALL
  UNION
  SELECT b.doc_id, max(a.pos), b.pos FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + {MIN_WORDS} AND b.upto - a.upto + a.w >= {MIN_WORDS} GROUP BY b.doc_id, b.pos),
t AS (SELECT runs.doc_id, s, e, array_to_string(string_split(text, chr(10))[s:e], chr(10)) AS x FROM runs JOIN documents USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, s, e) AS k FROM t),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM f WHERE k > 1),
r AS (SELECT l.doc_id, count(*) AS n, count(g.pos) AS d, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS x
  FROM l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(x, '') END AS text, CAST(coalesce(n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.d, 0) AS BIGINT) AS n_removed
FROM documents d LEFT JOIN r USING (doc_id)
"""
