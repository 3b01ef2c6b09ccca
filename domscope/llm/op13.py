"""The query op13_merkle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .merkle import folded, leaf_of, manifest, siblings_digest


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document its leaf, proof digest and roots, and whether a copy of it, tampered with where 7 divides the
    CRC-32 of its id, still folds to the root."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    n_chars = F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaf = lambda n: leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), n, F.col("text"))
    claimed = F.when(tampered, leaf(n_chars))
    held = manifest(table(spark, sf_dir, "documents"), leaf(F.col("n_chars")), "lang", "doc_id", {"doc_id": F.col("doc_id"), "claimed": claimed})
    out = held.withColumn("folded_root", folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    return out.select("doc_id", "leaf", "subroot", "root", siblings_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Level by level, and proofs and folds node by node. lang is prefixed, so that null is a value of its own and comes first.
ORACLE = r"""
WITH RECURSIVE f AS (
  SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree, n_chars,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
      lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), lambda z: CAST(z AS BIGINT)), lambda d, i: xor(d >> 1, 3988292384 * (d & 1)))), 4294967295) % 7 = 0 AS bad,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents),
h AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
    CASE WHEN bad THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS claimed
  FROM f),
leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM h),
sub AS (
  SELECT 0 AS lvl, tree, pos, leaf AS node, count(*) OVER (PARTITION BY tree) AS m FROM leaves
  UNION ALL
  SELECT lvl + 1, tree, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(m) + 1) // 2 FROM sub WHERE m > 1 GROUP BY lvl, tree, pos // 2),
roots AS MATERIALIZED (SELECT tree, node, lvl AS height, row_number() OVER (ORDER BY tree) - 1 AS pos FROM sub WHERE m = 1),
top AS (
  SELECT 0 AS lvl, pos, node, count(*) OVER () AS m FROM roots
  UNION ALL
  SELECT lvl + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (any_value(m) + 1) // 2 FROM top WHERE m > 1 GROUP BY lvl, pos // 2),
nodes AS MATERIALIZED (
  SELECT tree, lvl, pos, node FROM sub WHERE m > 1
  UNION ALL SELECT r.tree, r.height + t.lvl, t.pos, t.node FROM roots r CROSS JOIN top t WHERE t.m > 1),
heights AS (SELECT tree, height, pos AS lang_pos, node AS subroot, (SELECT max(lvl) FROM top) AS more FROM roots),
path AS (
  SELECT l.tree, l.pos AS row_pos, k AS lvl, CASE WHEN k < height THEN l.pos >> k ELSE lang_pos >> (k - height) END AS pos
  FROM leaves l JOIN heights USING (tree), unnest(range(height + more)) AS u(k)),
steps AS MATERIALIZED (SELECT p.tree, p.row_pos, p.lvl, p.pos % 2 = 1 AS at_right, n.node FROM path p LEFT JOIN nodes n ON n.tree = p.tree AND n.lvl = p.lvl AND n.pos = xor(p.pos, 1)),
proofs AS (SELECT tree, row_pos, sha256(coalesce(string_agg(node, '' ORDER BY lvl), '')) AS proof_sha256 FROM steps GROUP BY ALL),
fold AS (
  SELECT tree, pos AS row_pos, CAST(0 AS BIGINT) AS lvl, coalesce(claimed, leaf) AS acc FROM leaves
  UNION ALL
  SELECT f.tree, f.row_pos, f.lvl + 1, sha256(CASE WHEN s.at_right THEN coalesce(s.node, '') || f.acc ELSE f.acc || coalesce(s.node, '') END)
  FROM fold f JOIN steps s ON s.tree = f.tree AND s.row_pos = f.row_pos AND s.lvl = f.lvl)
SELECT l.doc_id, l.leaf, subroot, t.node AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, acc AS folded_root, acc = t.node AS verified
FROM leaves l JOIN heights USING (tree) JOIN (SELECT node FROM top WHERE m = 1) t ON TRUE
LEFT JOIN proofs p ON p.tree = l.tree AND p.row_pos = l.pos
JOIN fold f ON f.tree = l.tree AND f.row_pos = l.pos AND f.lvl = height + more
"""
