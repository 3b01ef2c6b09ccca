"""Incremental processing of arriving files, each exactly once, late ones too."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def arriving_domains(spark: SparkSession, folder: str, files_at_once: int = 100) -> DataFrame:
    """A stream of domain and day from text files named by day; what has been read is kept in the checkpoint by
    file name, so a day that arrives late is read when it comes."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_at_once).option("wholetext", False).text(folder)
    named = raw.select(F.btrim("value").alias("domain"), F.regexp_extract(F.col("_metadata.file_name"), r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("day"))
    return named.where("domain <> '' AND NOT startswith(domain, '#')")


def run_available(stream: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], name: str | None = None) -> None:
    """Handle all that has arrived, then stop. ``handle`` gets a batch and its number; after a failure the same
    batch comes again with the same number."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle)
    query = (writer.queryName(name) if name else writer).start()
    query.awaitTermination()


def into_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A handler that writes each batch to a folder of its own number, so that a batch that comes again
    replaces itself."""

    def handle(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return handle


def daily_windows(events: DataFrame, ts: str, late: str = "1 day", *keys: str) -> DataFrame:
    """An extension: counts by day of an event-time stream, final once ``late`` has passed."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, "1 day").alias("day"), *keys).agg(F.count(F.lit(1)).alias("n"))
