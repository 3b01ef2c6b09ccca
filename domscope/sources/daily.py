"""The daily feed: a ZIP for each day, <root>/YYYY-MM/YYYY-MM-DD-domain.zip with the member dailyupdate.txt.

``spark.read.format("daily_domains")`` with the options path, start and end gives day, domain, status; a partition
is a day, so only the days asked for are opened. A day that is missing or can't be read is one row with
a null domain and the status. Paths are opened with pyarrow's file systems, local ones or by URI.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MEMBER = "dailyupdate.txt"
#: The first day that may be asked for on demand, and the most days.
FIRST_DAY, MOST_DAYS = date(2024, 9, 1), 31


def day_path(root: str, day: date) -> str:
    return f"{root.rstrip('/')}/{day:%Y-%m}/{day:%Y-%m-%d}-domain.zip"


def _open(path: str) -> bytes:
    import pyarrow.fs as pafs

    fs, inner = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path.removeprefix("file:"))
    with fs.open_input_file(inner) as f:
        return f.read()


class Day(InputPartition):
    def __init__(self, day: date):
        self.day = day


class DailyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        start, end = date.fromisoformat(options["start"]), date.fromisoformat(options["end"])
        self.start, self.end = min(start, end), max(start, end)  # ends the wrong way round are swapped

    def partitions(self) -> list[Day]:
        return [Day(self.start + timedelta(n)) for n in range((self.end - self.start).days + 1)]

    def read(self, partition: Day) -> Iterator[tuple]:
        try:
            data = _open(day_path(self.root, partition.day))
        except FileNotFoundError:  # other failures - no access, a store that is down - fail the task
            yield partition.day, None, "missing"
            return
        try:
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                text = z.read(MEMBER).decode("utf-8", "ignore")
        except (zipfile.BadZipFile, KeyError, RuntimeError):
            yield partition.day, None, "unreadable"
            return
        yield partition.day, None, "read"
        for line in text.splitlines():
            if line.strip():
                yield partition.day, line.strip(), "read"


class DailyDomains(DataSource):
    @classmethod
    def name(cls) -> str:
        return "daily_domains"

    def schema(self) -> str:
        return "day date, domain string, status string"

    def reader(self, schema) -> DailyReader:
        return DailyReader(self.options)


def daily_feed(spark: SparkSession, root: str, start: str, end: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(domain, missing days) of a range of days, each domain once. ``strict`` is for ranges that users ask for:
    not before the first day, and not more days than the most."""
    a, b = sorted((date.fromisoformat(start), date.fromisoformat(end)))
    if strict and (a < FIRST_DAY or (b - a).days >= MOST_DAYS):
        raise ValueError(f"a range begins on {FIRST_DAY} or later and has at most {MOST_DAYS} days")
    spark.dataSource.register(DailyDomains)
    rows = spark.read.format("daily_domains").options(path=root, start=a.isoformat(), end=b.isoformat()).load()
    return rows.where("domain IS NOT NULL").select("domain").distinct(), rows.where("domain IS NULL AND status <> 'read'").select("day", "status").distinct()
