"""The query op4_html_text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .html_text import extract


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the main text of its html and the number of its code points."""
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
