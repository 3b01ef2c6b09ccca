"""Operators on listings that are shown: grouping, name resolution, timelines, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.labels import REGIONS
from ..functions.names import normal_organization
from ..plans.relational import all_of, first_by_key


def resolve_organization(events: DataFrame, event_key: str, org_id: str, org_name: str, organizations: DataFrame) -> DataFrame:
    """``events`` with resolved_id: the organization by id; else by normalised name; else by an alias (that of
    the organization with the smallest id); else one whose name or alias contains the event's or is part of it
    (smallest id). The last step joins only the distinct names that are still open."""
    name = normal_organization(F.coalesce(F.col(org_name), F.lit("")))
    e = events.withColumn("__name", F.when(name != "", name))
    ids = organizations.select(F.col("id").alias("__by_id"))
    own = organizations.select("id", normal_organization(F.col("name")).alias("n"), F.lit(0).alias("kind"))
    other = organizations.select("id", F.explode("alias").alias("a")).select("id", normal_organization(F.col("a")).alias("n"), F.lit(1).alias("kind"))
    known = own.unionByName(other).where("n <> ''")
    # A later organization's name wins over an earlier one's of the same form; any name wins over an alias.
    by_name = first_by_key(known, ["n"], [F.col("kind"), F.when(F.col("kind") == 0, -F.col("id")).otherwise(F.col("id"))]).select(F.col("n").alias("__name"), F.col("id").alias("__by_name"))
    joined = e.join(ids, F.col(org_id) == F.col("__by_id"), "left").join(by_name, "__name", "left")
    open_names = joined.where("__by_id IS NULL AND __by_name IS NULL AND __name IS NOT NULL").select("__name").distinct()
    close = open_names.join(known.select("id", "n"), F.contains("n", F.col("__name")) | F.contains(F.col("__name"), F.col("n")))
    fuzzy = close.groupBy("__name").agg(F.min("id").alias("__fuzzy"))
    out = joined.join(fuzzy, "__name", "left")
    return out.select(*events.columns, F.coalesce("__by_id", "__by_name", "__fuzzy").alias("resolved_id"))


def latest_event_per_organization(events: DataFrame, org_id: str, org_name: str, day: str, tie: str) -> DataFrame:
    """The latest event of each organization - known by id, else by normalised name, else as unknown - oldest
    first."""
    name = normal_organization(F.coalesce(F.col(org_name), F.lit("")))
    key = F.coalesce(F.col(org_id).cast("string"), F.when(name != "", name), F.lit("unknown"))
    rows = first_by_key(events.withColumn("org_key", key), ["org_key"], [F.desc(day), F.desc(tie)])
    return rows.orderBy(day, tie)


def bucketed(df: DataFrame, c: str, known: tuple[str, ...] = REGIONS, other: str = "未知") -> DataFrame:
    """``df`` with bucket: the value if it is known, else the other one."""
    return df.withColumn("bucket", F.when(F.col(c).isin(*known), F.col(c)).otherwise(other))


def grouped_names(df: DataFrame, bucket: str, name: str) -> DataFrame:
    """For each bucket its rows and its names, sorted."""
    return df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(name)).alias("names"))


def name_width(df: DataFrame, name: str, least: int = 8) -> DataFrame:
    """The length of the longest trimmed name, at least 8."""
    return df.agg(F.greatest(F.coalesce(F.max(F.char_length(F.trim(name))), F.lit(0)), F.lit(least)).alias("width"))


def active_since(organizations: DataFrame, changed: str, day: str) -> DataFrame:
    """How many organizations changed after the day."""
    return organizations.agg(F.count(F.when(F.col(changed) > F.lit(day).cast("date"), 1)).alias("active"))


def label_totals(counts: DataFrame, labels: DataFrame, label: str, measure: str) -> DataFrame:
    """The sum for each of the labels, 0 without rows."""
    sums = counts.groupBy(label).agg(F.sum(measure).alias("total"))
    return labels.join(sums, label, "left").withColumn("total", F.coalesce("total", F.lit(0)))


def timeline_range(events: DataFrame, day: str) -> DataFrame:
    """One row: first, last and days of a timeline with a month to spare on both sides, two if that makes less
    than 60 days; null without events."""
    edge = events.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    start, end = F.add_months(F.trunc("lo", "month"), -1), F.add_months(F.last_day("hi"), 1)
    # The end of the month of the last event, moved by a month, keeps its day where that exists.
    end = F.when(F.day(end) > F.day(F.last_day("hi")), F.last_day(end)).otherwise(end)
    tight = F.datediff(end, start) < 60
    out = edge.select(F.when(tight, F.add_months(start, -1)).otherwise(start).alias("first"), F.when(tight, F.add_months(end, 1)).otherwise(end).alias("last"))
    return out.withColumn("days", F.greatest(F.datediff("last", "first"), F.lit(1)))


def timeline_months(span: DataFrame) -> DataFrame:
    """The months of a timeline."""
    months = F.sequence(F.trunc("first", "month"), F.trunc("last", "month"), F.expr("interval 1 month"))
    return span.where("first IS NOT NULL").select(F.explode(months).alias("month"))


def timeline_position(events: DataFrame, day: str, span: DataFrame) -> DataFrame:
    """``events`` with position: where the day lies on the timeline, in percent from 0 to 100."""
    share = F.datediff(F.col(day), F.col("first")) / F.col("days") * 100
    return events.join(F.broadcast(span)).withColumn("position", F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))).drop("first", "last", "days")


def distinct_years(events: DataFrame, day: str) -> DataFrame:
    return events.where(F.col(day).isNotNull()).select(F.year(day).alias("year")).distinct().orderBy("year")


def pages_within(df: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """``df`` with the number of the page of its key's rows that each row is on."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("page", F.floor((rank - 1) / size).cast("int") + 1)


def task_filter(kind: str | None = None, status: str | None = None, first_day: str | None = None, last_day: str | None = None, keyword: str | None = None, created: str = "created_at", kind_col: str = "task_type", status_col: str = "status", texts: tuple[str, ...] = ("task_id", "model_name", "file_name")) -> Column:
    """Tasks of a type and status, from the first day to the end of the last, with the keyword in a text."""
    found = None
    if keyword and keyword.strip():
        found = F.lit(False)
        for c in texts:
            found = found | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(keyword.strip().lower())), F.lit(False))
    return all_of(
        [
            F.col(kind_col) == kind if kind else None,
            F.col(status_col) == status if status else None,
            F.col(created) >= F.lit(first_day).cast("timestamp") if first_day else None,
            F.col(created) < F.date_add(F.lit(last_day).cast("date"), 1).cast("timestamp") if last_day else None,
            found,
        ]
    )


def market_filter(category: str | None, c: str = "model_category", named: tuple[str, ...] = ("malicious", "impersonation")) -> Column:
    """Models of a category; ``other`` are those of none or of one without a name."""
    if not category or category == "all":
        return F.lit(True)
    return F.col(c).isNull() | ~F.col(c).isin(*named) if category == "other" else F.col(c) == category


def by_name(df: DataFrame, name: str, tie: str, descending: bool = False) -> DataFrame:
    """Sorted by name as people would, not by code points."""
    key = F.collate(F.col(name), "UNICODE")
    return df.orderBy(key.desc() if descending else key.asc(), tie)
