"""The query op10_byte_bpe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the vocabulary that the query uses."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of tokens, and digests of its ids and of the bytes decoded from them."""
    path, pattern = vocabulary()
    return bpe.encode(table(spark, sf_dir, "documents"), path, pattern, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded_bytes", 256).alias("decoded_sha256"),
    )
