"""Folders of archives, each with a list of domains, whose features are kept by content and not computed twice.

A folder, at any depth, holds ZIP archives, and maybe archives within these, with a member dailyupdate.txt, or that file itself. Spark lists
the folder; tasks read the files as streams, in ranges of paths, and no task holds more than a member's lines. What was seen
is known by the digest of the file's bytes, so an archive that was renamed or copied is not read again.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.detection import with_features
from ..session import stored
from .daily import MEMBER
from .files import _hadoop

#: Lines in a batch, bytes read at a time, and archives within archives.
LINES, CHUNK, DEPTH = 10_000, 1 << 20, 3


def _input(path: str):
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    return fs.open_input_file(inner)


def _lines(file, name: str, depth: int = 0) -> Iterator[str]:
    """The lines of the list in a file, and of those in archives within it; none if it can't be read."""
    if not name.endswith(".zip"):
        yield from io.TextIOWrapper(file, "utf-8", "ignore")
        return
    try:
        z = zipfile.ZipFile(file)
    except (zipfile.BadZipFile, pa.ArrowInvalid):  # the second for a file that is shorter than any archive
        return
    with z:
        for member in z.namelist():
            if member.rpartition("/")[2] == MEMBER or (member.endswith(".zip") and depth < DEPTH):
                try:
                    with z.open(member) as inner:
                        yield from _lines(inner, member, depth + 1)
                except (zipfile.BadZipFile, RuntimeError):  # damaged, or locked by a password
                    continue


def found(spark: SparkSession, root: str) -> DataFrame:
    """path, digest of the archives and lists below ``root``."""
    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True).load(root).select("path")
    wanted = listed.where(F.endswith("path", F.lit(".zip")) | F.endswith("path", F.lit(f"/{MEMBER}")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                with _input(path) as f:
                    while data := f.read(CHUNK):
                        digest.update(data)
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.string())], ["path", "digest"])

    return stored(wanted.mapInArrow(run, "path string, digest string"), "found")


def domains(archives: DataFrame) -> DataFrame:
    """digest, domain of the lists in ``archives`` (path, digest): trimmed lines that aren't blank. An archive without any has a row with a null."""
    # The paths alone are dealt out anew, so that archives spread over all tasks.
    dealt = archives.select("path", "digest").repartition("digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, digest in zip(*(c.to_pylist() for c in batch.columns)):
                held, some = [], False
                with _input(path) as f:
                    for line in _lines(f, path):
                        if name := line.strip():
                            held.append(name)
                            some = True
                        if len(held) >= LINES:
                            yield pa.RecordBatch.from_arrays([pa.array([digest] * len(held)), pa.array(held)], ["digest", "domain"])
                            held = []
                if held or not some:
                    held = held or [None]
                    yield pa.RecordBatch.from_arrays([pa.array([digest] * len(held), pa.string()), pa.array(held, pa.string())], ["digest", "domain"])

    return dealt.mapInArrow(run, "digest string, domain string")


def traverse(spark: SparkSession, root: str, cache: str, segment: Callable[[Column], Column] | None = None) -> DataFrame:
    """path, domain and its lexical features for all archives below ``root``. Features of archives whose content ``cache`` doesn't have are
    computed and added to it, all of them or, if that fails, none; the others are read from there."""
    there = found(spark, root)
    place, fs = _hadoop(spark, cache)
    known = spark.read.parquet(cache) if fs.exists(place) else None
    new = there.groupBy("digest").agg(F.min("path").alias("path"))
    if known is not None:
        new = new.join(known.select("digest").distinct(), "digest", "left_anti")
    if not new.isEmpty():
        with_features(domains(new), "domain", segment).write.mode("append").parquet(cache)
    if known is None and not fs.exists(place):
        known = with_features(domains(there), "domain", segment)
    else:
        known = spark.read.parquet(cache)
    return known.where("domain IS NOT NULL").join(there, "digest").select("path", *[c for c in known.columns if c != "digest"])
