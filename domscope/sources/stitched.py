"""One text file of any length, in order, though no task holds more than a range of it."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from .files import _hadoop


def write_stitched(lines: DataFrame, order: list[str], path: str, head: str = "", tail: str = "") -> None:
    """A file of ``head``, the column line of ``lines`` in this order, each with a line end, and ``tail``. Tasks write ranges as files of their
    own; then the driver's JVM copies these, one after another, as bytes through a small buffer into a file that appears at ``path`` when it
    is whole. A failure before leaves what was there."""
    spark = lines.sparkSession
    work = f"{path}.{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.text(f"{work}/ranges")
    place, fs = _hadoop(spark, work)
    try:
        ranges = sorted(s.getPath().toString() for s in fs.listStatus(_hadoop(spark, f"{work}/ranges")[0]) if s.getPath().getName().startswith("part-"))
        stitch(spark, work, [head.encode(), *ranges, tail.encode()], path)
    finally:
        fs.delete(place, True)


def stitch(spark: SparkSession, work: str, pieces: Iterable[bytes | str], path: str) -> None:
    """A file of ``pieces``, bytes or the paths of files, one after another. It is made in the folder ``work`` and moved when it is whole."""
    jvm = spark.sparkContext._jvm
    path_of = jvm.org.apache.hadoop.fs.Path
    whole, fs = _hadoop(spark, f"{work}/whole")
    out = fs.create(whole)
    try:
        for piece in pieces:
            if isinstance(piece, bytes):
                out.write(bytearray(piece))
                continue
            part = fs.open(path_of(piece))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 16, False)
            finally:
                part.close()
    finally:
        out.close()
    target = path_of(path)
    fs.mkdirs(target.getParent())
    fs.delete(target, True)
    if not fs.rename(whole, target):
        raise OSError(f"{path} can't be written")
