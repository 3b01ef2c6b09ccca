"""The query op11_licenses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_scan import labels, scan


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its words, the places where a base phrase stands word by word, the labels of these and those of all notices
    found, and the likeness of the best one (0 without any)."""
    found = scan(table(spark, sf_dir, "documents")).withColumn("exact", F.filter("notices", lambda x: x["base"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min("exact.begin").cast("long").alias("first_word"),
        F.array_max("exact.begin").cast("long").alias("last_word"),
        labels(F.col("exact")).alias("base_labels"),
        labels(F.col("notices")).alias("labels"),
        F.coalesce(F.array_max("notices.likeness"), F.lit(0.0)).alias("score"),
    )
