"""Text files in, text files out."""

from __future__ import annotations

import codecs
import csv
import io
import itertools
import sys
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import STAGING
from ..session import stored

#: What Spark's own reader decodes.
SPARK_CHARSETS = ("iso-8859-1", "us-ascii", "utf-16", "utf-16be", "utf-16le", "utf-32", "utf-8")
# The header of the alert table.
ALERT_HEADER = {"malicious": ("序号", "恶意域名"), "impersonation": ("序号", "仿冒域名")}


def staged_csv(spark: SparkSession, path: str, columns: Sequence[str] | str, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header as text columns by place; the names in the header don't count. Quotes are
    doubled within quotes; values may hold line ends. ``columns``: names, or that of a staged table."""
    names = list(STAGING[columns] if isinstance(columns, str) else columns)
    schema = ", ".join(f"`{c}` string" for c in names)
    if encoding.lower() not in SPARK_CHARSETS:
        return _decoded_csv(spark, path, names, schema, encoding)
    return spark.read.schema(schema).options(header=True, enforceSchema=True, quote='"', escape='"', multiLine=True, encoding=encoding).csv(path)


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files for tasks that open_file() them: content is null where pyarrow opens the path, so that they are read as streams."""
    import pyarrow.fs as pafs

    found = spark.read.format("binaryFile").load(path)
    place, fs = _hadoop(spark, path)
    where = fs.makeQualified(place).toString()
    try:
        if not where.startswith("file:"):
            pafs.FileSystem.from_uri(quote(where, "/:@"))
    except (pa.ArrowInvalid, OSError):  # a store that only Spark reads
        return found.select("path", "content")
    return found.select("path", F.lit(None).cast("binary").alias("content"))


def open_file(path: str, content: bytes | None):
    """A file of whole_files(), in a task."""
    import pyarrow.fs as pafs

    if content is not None:
        return io.BytesIO(content)
    fs, inner = pafs.FileSystem.from_uri(quote(path, "/:@")) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs.open_input_file(inner)


def _text(file, encoding: str) -> io.TextIOBase:
    """The text of a file as a stream; what can't be decoded is replaced as it would be in the whole."""
    kind = codecs.lookup(encoding).name
    if kind in ("hz", "utf-7") or kind.startswith("iso2022"):
        # Streams of these fail where escapes are damaged.
        return io.StringIO(file.read().decode(encoding, "replace"), newline="")
    marks = {"utf-16": (codecs.BOM_UTF16_LE, codecs.BOM_UTF16_BE), "utf-32": (codecs.BOM_UTF32_LE, codecs.BOM_UTF32_BE)}
    if kind in marks:
        # Streams of these fail without a byte-order mark.
        if not file.read(4).startswith(marks[kind]):
            encoding = f"{kind}-{sys.byteorder[0]}e"
        file.seek(0)
    return io.TextIOWrapper(file, encoding, "replace", newline="")


def _decoded_csv(spark: SparkSession, path: str, names: list[str], schema: str, encoding: str) -> DataFrame:
    """For character sets that Spark's reader doesn't take: a task decodes a file as a stream, some rows at a time."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(place, content) as file, _text(file, encoding) as text:
                    read = csv.reader(text)
                    next(read, None)
                    while part := list(itertools.islice(read, 10_000)):
                        whole = [[v or None for v in r[: len(names)]] + [None] * (len(names) - len(r)) for r in part if r]
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in whole], pa.string()) for k in range(len(names))], names)

    return whole_files(spark, path).mapInArrow(rows, schema)


def write_encoded_csv(df: DataFrame, path: str, encoding: str) -> None:
    """CSV files with a header in any character set, one for each partition, in a folder that pyarrow opens."""
    import pyarrow.fs as pafs

    names = df.columns
    pafs.FileSystem.from_uri(path)[0].create_dir(pafs.FileSystem.from_uri(path)[1]) if "://" in path else pafs.LocalFileSystem().create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
        rows = 0
        with fs.open_output_stream(f"{inner}/{uuid.uuid4().hex}.csv", compression=None) as out:
            for head, batch in enumerate(batches):
                text = io.StringIO(newline="")
                csv.writer(text).writerows(([] if head else [names]) + list(zip(*(c.to_pylist() for c in batch.columns))))
                out.write(text.getvalue().encode(encoding))
                rows += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["n"])

    df.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def lines(spark: SparkSession, path: str) -> DataFrame:
    """The trimmed lines of a text file, without blank ones and remarks (#); what isn't UTF-8 is left out."""
    text = F.replace(F.make_valid_utf8("value"), F.lit("\ufffd"), F.lit(""))
    rows = spark.read.text(path).select(F.btrim(F.regexp_replace(text, "^\ufeff|[\r\t]", " ")).alias("value"))
    return rows.where("value <> '' AND NOT startswith(value, '#')")


def domain_list(spark: SparkSession, path: str) -> DataFrame:
    """Domains from .txt, one a line, or .csv: the column domain if there is one, else the first. Blank
    values are left out; values are not trimmed."""
    if path.lower().endswith(".txt"):
        return lines(spark, path).withColumnRenamed("value", "domain")
    df = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
    c = "domain" if "domain" in df.columns else df.columns[0]
    return df.select(F.col(f"`{c}`").alias("domain")).where(F.trim("domain") != "")


def _pair(value: Column) -> list[Column]:
    cut = F.split(value, ",", 2)
    return [F.trim(cut[0]).alias("company"), F.trim(F.get(cut, F.lit(1))).alias("domain")]


def official_list(spark: SparkSession, path: str) -> DataFrame:
    """company, domain from .csv (the first two columns; a file of one column is cut at its commas) or .txt."""
    if not path.lower().endswith(".txt"):
        df = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(path)
        if len(df.columns) >= 2:
            # A missing value is the text nan there, which counts as a value.
            text = [F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("nan"))).alias(name) for c, name in zip(df.columns, ("company", "domain"))]
            return df.select(*text).where("company <> '' AND domain <> ''")
    return lines(spark, path).select(*_pair(F.col("value"))).where("company <> '' AND domain <> ''")


def training_list(spark: SparkSession, path: str) -> DataFrame:
    """domain, label from lines of both; lines whose label isn't 0 or 1 are left out. More fields don't matter."""
    cut = F.split("value", ",")
    rows = spark.read.text(path).where(F.size(cut) >= 2).select(F.trim(cut[0]).alias("domain"), F.trim(cut[1]).try_cast("int").alias("label"))
    return rows.where("label IN (0, 1)")


def preview(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows of a training list that have a domain."""
    return rows.where("domain <> ''").limit(n)


def write_results(path: str, results: DataFrame, statistics: DataFrame, positive: DataFrame) -> None:
    """A result as three tables under a path: all rows, the statistics, and the positive ones."""
    for name, df in (("results", results), ("statistics", statistics), ("positive", positive)):
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_results(spark: SparkSession, path: str, positive: Column) -> Mapping[str, DataFrame]:
    """What write_results() wrote; positive rows are picked anew where they are missing."""
    out = {name: spark.read.parquet(f"{path}/{name}") for name in ("results", "statistics")}
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/positive")
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return out | {"positive": spark.read.parquet(f"{path}/positive") if there else out["results"].where(positive)}


def write_alert_csv(df: DataFrame, path: str, kind: str = "malicious", domain: str = "domain") -> None:
    """One CSV file of numbered domains for people to open: an alert is short. The byte-order mark is part of
    the header, for spreadsheets."""
    number, name = ALERT_HEADER[kind]
    ordered = df.select(F.col(domain).alias(name)).orderBy(name).coalesce(1)
    rows = ordered.select((F.monotonically_increasing_id() + 1).alias("\ufeff" + number), name)
    rows.write.mode("overwrite").options(header=True, encoding="UTF-8").csv(path)


def document_path(when, user: int, subscription: str, task: str, alert: str) -> str:
    """Where an alert's document is kept."""
    return f"alerts/{when:%Y/%m/%d}/user_{user}/subscription_{subscription}/task_{task}/alert_{alert}/full_result.json"


def write_document(document: DataFrame, path: str) -> None:
    """A document of one row, as text. The committer makes it appear whole or not at all."""
    document.select("document").coalesce(1).write.mode("overwrite").text(path)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_object(spark: SparkSession, content: bytes, filename: str, bucket: str) -> str:
    """Stores what a user uploads, which the caller holds anyway, and gives its key: a random name with the ending of
    the file's. The folder is made if need be."""
    key = f"{uuid.uuid4().hex}.{filename.rsplit('.', 1)[-1] if '.' in filename else ''}"
    place, fs = _hadoop(spark, f"{bucket}/{key}")
    out = fs.create(place, False)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return key


def put_objects(objects: DataFrame, bucket: str, ending: str) -> DataFrame:
    """The other columns of ``objects`` with the key under which the column content was stored, one object a row. Keys are drawn before, so a
    task that runs again writes its objects again under the same keys."""
    spark = objects.sparkSession
    keyed = stored(objects.withColumn("key", F.concat(F.replace(F.uuid(), F.lit("-")), F.lit(f".{ending}"))), "objects")
    place, fs = _hadoop(spark, bucket)
    fs.mkdirs(place)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs as pafs

        store, root = pafs.FileSystem.from_uri(bucket)
        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content")):
                with store.open_output_stream(f"{root}/{key}", compression=None) as f:
                    f.write(content.as_buffer())
            yield batch.select(["key"])

    keyed.where("content IS NOT NULL").select("key", "content").mapInArrow(write, "key string").write.format("noop").mode("overwrite").save()
    return keyed.where("content IS NOT NULL").drop("content")


def get_objects(spark: SparkSession, bucket: str, keys: DataFrame | None = None) -> DataFrame:
    """key, content of the objects of a bucket, or of those that ``keys`` (key) names."""
    found = spark.read.format("binaryFile").load(bucket).select(F.element_at(F.split("path", "/"), -1).alias("key"), "content")
    return found if keys is None else found.join(keys.select("key").distinct(), "key", "left_semi")


def document_row(document: DataFrame, bucket: str, key: str, facts: Mapping[str, str | int], when: Column) -> DataFrame:
    """The row of the table files for a document of one row; ``facts`` are added to its metadata."""
    # What the metadata always say.
    fixed = {"source": "scheduled_alert", "artifact_type": "full_result", "file_format": "json", "schema_version": "v1"}
    meta = F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in {**fixed, **facts}.items()]))
    return document.select(
        F.lit(bucket).alias("bucket"), F.lit(key).alias("object_key"), F.lit(key.rsplit("/", 1)[-1]).alias("filename"),
        F.octet_length("document").cast("long").alias("size"), meta.alias("metadata"), when.cast("timestamp_ntz").alias("created_at"),
    )


def store_document(document: DataFrame, bucket: str, key: str, row: DataFrame, register: Callable[[DataFrame], None]) -> None:
    """Writes a document and registers its row; if that fails the document goes again, and the failure is passed on."""
    write_document(document, f"{bucket}/{key}")
    try:
        register(row)
    except Exception:
        place, fs = _hadoop(document.sparkSession, f"{bucket}/{key}")
        fs.delete(place, True)
        raise


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def with_columns(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` with null columns of the types for those it lacks."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})
