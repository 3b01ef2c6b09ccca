"""The query op6_near_copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .near_copies import similar_documents, with_rows


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: the class of similar documents it belongs to, by its smallest id, and its number of links."""
    found = similar_documents(with_rows(table(spark, sf_dir, "documents")))
    return found.selectExpr("id AS doc_id", "class_id", "n_links")


#: All pairs that share a gram, counted; classes by a recursive walk.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT doc_id, array_to_string(ws[s : s + least(len(ws), 5) - 1], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 5, 0) + 2)) AS s FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
b AS (SELECT a.doc_id AS p, c.doc_id AS q, count(*) AS k FROM g a JOIN g c ON a.x = c.x AND a.doc_id <> c.doc_id GROUP BY ALL),
e AS (SELECT p, q FROM b JOIN n x ON x.doc_id = p JOIN n y ON y.doc_id = q WHERE 10 * k >= 8 * (x.n + y.n - k)),
walk AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT walk.d, e.q FROM walk JOIN e ON e.p = walk.r),
c AS (SELECT d, min(r) AS class_id FROM walk GROUP BY d),
l AS (SELECT p, count(*) AS n_links FROM e GROUP BY p)
SELECT d AS doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links FROM c LEFT JOIN l ON l.p = c.d
"""
