"""The session that the engine's own programs use; queries work in any session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere, ANSI errors instead of silent nulls, and run-time replanning for skew and small inputs.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "domscope", **settings: str) -> SparkSession:
    """A session with SETTINGS, and ``settings`` on top (dots written as two underscores)."""
    builder = SparkSession.builder.appName(name).config(map=SETTINGS)
    return builder.config(map={k.replace("__", "."): v for k, v in settings.items()}).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under what spark.checkpoint.dir names, or in local mode, where that is
    unset, a temporary one. It is deleted when the driver's JVM ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='domscope-')}"
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path if "://" in path else path.replace("file:", "file://", 1)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what several jobs read is computed once, and is not lost with an executor."""
    path = f"{scratch(df.sparkSession, name)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
