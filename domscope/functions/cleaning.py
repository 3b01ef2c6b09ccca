"""Cleaning of staged text columns, and dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "未知"


def blank_to_null(c: Column) -> Column:
    """Trimmed; null if nothing is left."""
    t = F.trim(c)
    return F.when(t != "", t)


def or_default(c: Column, default) -> Column:
    """Trimmed text, or the default where it is blank."""
    return F.coalesce(blank_to_null(c), F.lit(default))


def to_int(c: Column) -> Column:
    """An integer from text by its numeric prefix: blank or without digits gives null."""
    return F.regexp_extract(F.trim(c), "^[+-]?[0-9]+", 0).try_cast("int")


def pipe_list(c: Column) -> Column:
    """``A | B | C`` as an array of strings; blank as an empty one."""
    t = blank_to_null(c)
    return F.when(t.isNull(), F.array().cast("array<string>")).otherwise(F.split(t, r" \| "))


def any_list(c: Column) -> Column:
    """A list from JSON (array, or scalar as one item, null as none) or else from text cut at , ; | and
    line ends; items are trimmed, blank ones dropped."""
    t = F.trim(c)
    parsed = F.from_json(t, "array<string>")
    looks = t.rlike(r"^\s*\[.*\]\s*$") & parsed.isNotNull()
    scalar = t.rlike(r'^(-?\d+(\.\d+)?|true|false|".*")$')
    cut = F.split(t, r"[,;|\n\r\t]+")
    items = (
        F.when(t.isNull() | (t == "") | (t == "null"), F.array().cast("array<string>"))
        .when(looks, parsed)
        .when(scalar, F.array(F.regexp_replace(t, '^"|"$', "")))
        .otherwise(cut)
    )
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def slash_date(c: Column) -> Column:
    """A date written year/month/day, padded or not."""
    return F.try_to_date(F.trim(c), "y/M/d")


def mixed_date(c: Column) -> Column:
    """A date as text with - or /, or as a spreadsheet's day number; null otherwise."""
    t = F.trim(c)
    text = F.try_to_date(F.replace(t, F.lit("/"), F.lit("-")), "y-M-d")
    serial = F.date_add(F.lit("1899-12-30").cast("date"), F.floor(t.try_cast("double")).try_cast("int"))
    return F.when(t.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"), text).when(t.rlike(r"^[0-9]{1,6}(\.[0-9]+)?$"), serial)


def any_date(c: Column) -> Column:
    """A date from the first format that fits: dates and times with - or /, day-month name-year, ISO."""
    t = F.trim(c)
    formats = ["y-M-d", "y/M/d", "y-M-d H:m:s", "y/M/d H:m:s", "d-MMM-y"]
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)).cast("date") for f in formats], F.to_date(F.regexp_extract(t, r"^(\d{4}-\d{2}-\d{2})T", 1).try_cast("date")))


def certificate_time(c: Column) -> Column:
    """A certificate's time, such as ``Jan  5 12:00:00 2024 GMT``, with or without zone, or ISO."""
    t = F.regexp_replace(F.trim(c), r"\s+", " ")
    bare = F.regexp_replace(t, r" [A-Z]{2,5}$", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("MMM d H:m:s y")), t.try_cast("timestamp"))


def iso_day(c: Column) -> Column:
    """The calendar day of an ISO text, in the offset it is written with."""
    return F.substring(F.trim(c), 1, 10).try_cast("date")


def local_time(ts: Column, zone: str = "Asia/Shanghai") -> Column:
    """A UTC time as wall-clock time of the zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def relative_time(then: Column, now: Column) -> Column:
    """How long ago in whole days, hours or minutes; ``just now`` below one minute."""
    s = now.cast("timestamp").cast("long") - then.cast("timestamp").cast("long")
    text = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    return F.when(s >= 86400, text(s / 86400, "days")).when(s >= 3600, text(s / 3600, "hours")).when(s >= 60, text(s / 60, "minutes")).when(s.isNotNull(), F.lit("just now"))


def plain(c: Column) -> Column:
    """A struct, array or map as JSON text, decimals as numbers, dates in ISO form."""
    return F.to_json(c)


def percent_text(part: Column, whole: Column) -> Column:
    """part / whole as ``12.34%``; ``0.00%`` of nothing."""
    return F.format_string("%.2f%%", F.when(whole == 0, F.lit(0.0)).otherwise(100.0 * part / whole))
