"""The query op9_toxicity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .toxicity import learn, score

THRESHOLD = 0.7


def held_out(doc_id: Column) -> Column:
    """Whether the fold of an id is kept from learning. A null id is in no fold."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fold_model(spark: SparkSession, docs: DataFrame, sf_dir: str):
    """The model learnt from the labels outside the held-out fold."""
    return learn(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label was held out, its score, and the prediction at THRESHOLD."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fold_model(spark, docs, sf_dir)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )
