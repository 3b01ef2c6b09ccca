"""The query op1_pii."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .pii import KINDS, pseudonymise

#: For the query only; give an own, secret key in production.
KEY = "domscope-demo-key"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its text with pseudonyms, and how many values of each kind were replaced."""
    done = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), *[count(k) for k in KINDS])
