"""The query op8_decontaminate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import find_hits

WINDOW = 10


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, those inside benchmark windows, and the items these come from."""
    found = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), WINDOW)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


#: Windows are looked up by the digest-free text of their words, joined by single spaces.
ORACLE = r"""
WITH dw AS (
  SELECT doc_id, w, CAST(i AS BIGINT) AS i FROM (
    SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (
      SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM documents WHERE text IS NOT NULL))),
il AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[s : s + least(len(ws), 10) - 1], ' ') AS t
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS s FROM il WHERE len(ws) > 0)),
dl AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM dw GROUP BY doc_id),
grams AS (
  SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS t
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM dl, (SELECT DISTINCT n FROM win) WHERE len(ws) >= n)),
hit AS (SELECT g.doc_id, g.s, g.n, w.item_id FROM grams g JOIN win w ON w.n = g.n AND w.t = g.t),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(dl.ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN dl USING (doc_id) LEFT JOIN places USING (doc_id) LEFT JOIN its USING (doc_id)
"""
