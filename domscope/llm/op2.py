"""The query op2_warc_index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .warc import merge_runs, read_runs, write_archives

LEAST_BYTES = 0


def op2_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back and merged into one index in order of URL key and time."""
    archives = write_archives(table(spark, sf_dir, "pages"), LEAST_BYTES)
    return merge_runs(read_runs(archives)).selectExpr("id AS page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Five bits of the digest at a time: a hex digit and a bit of the next one, in turns.
_BASE32 = " || ".join(
    f"'{_ALPHABET}'[1 + (((('0x' || substr(h, {5 * k // 4 + 1}, 2))::INT >> {3 - (5 * k) % 4}) & 31))]" for k in range(32)
)
ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) || '0' AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h, payload_bytes) AS last, payload_bytes < {LEAST_BYTES}
    OR row_number() OVER (PARTITION BY h, payload_bytes ORDER BY page_id DESC NULLS LAST, url DESC) = 1 AS alone FROM d)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN alone THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN NOT alone THEN last END AS refers_to
FROM m
"""
