"""The query op3_token_rollup: a life of the corpus in four batches, one of them sent twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, table, written
from .token_rollup import TokenRollup

#: What the tokenizer versions count, in the regular expressions that Java and RE2 share.
SPACED = r"[^ \t\n\r]+"
PIECES = r"[0-9A-Za-z]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"
WORDS = r"[0-9A-Za-z]+|[^\x00-\x7F]+"


def op3_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after every document was inserted with the versions spaced-1 and pieces-1, all counts of
    spaced-1 were revised (words only), and the later copies of equal texts were deleted; null texts have
    0 tokens and are never copies. The revision is sent twice and counts once."""
    count = lambda pattern: F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.sha2("text", 256).alias("digest"), count(SPACED).alias("spaced"), count(PIECES).alias("pieces"), count(WORDS).alias("words")
    )
    docs = written(docs, "counts")

    def changes(rows: DataFrame, op: str, **counts: str) -> DataFrame:
        each = [F.struct(F.lit(name.replace("_", "-")).alias("tokenizer"), F.col(new).alias("tokens")) for name, new in counts.items()]
        return rows.select("source", "lang", F.lit(op).alias("op"), F.explode(F.array(*each)).alias("c"), F.lit(None).cast("long").alias("old_tokens")).select("op", "source", "lang", "c.*", "old_tokens")

    first = written(docs.where("digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"), "copies")
    copies = docs.join(first, "digest").where("doc_id <> first")
    revised = docs.select(F.lit("revise").alias("op"), "source", "lang", F.lit("spaced-1").alias("tokenizer"), F.col("words").alias("tokens"), F.col("spaced").alias("old_tokens"))
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    rollup.apply("load", changes(docs, "insert", spaced_1="spaced", pieces_1="pieces"))
    rollup.apply("recount", revised)
    rollup.apply("copies", changes(copies, "delete", spaced_1="words", pieces_1="pieces"))
    rollup.apply("recount", revised)
    return rollup.totals()


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS words,
    coalesce(len(regexp_extract_all(text, '{PIECES}')), 0) AS pieces,
    text IS NOT NULL AND doc_id <> min(doc_id) OVER (PARTITION BY text) AS copy
  FROM documents),
c AS (SELECT source, lang, 'spaced-1' AS tokenizer, words AS tokens FROM d WHERE NOT coalesce(copy, FALSE)
  UNION ALL SELECT source, lang, 'pieces-1', pieces FROM d WHERE NOT coalesce(copy, FALSE))
SELECT source, lang, tokenizer, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(tokens) AS BIGINT) AS n_tokens FROM c GROUP BY ALL
"""
