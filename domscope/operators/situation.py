"""Situation-awareness queries: totals, trends, distributions, heat maps, top entities.

Each takes the tables it needs and the names of the columns that play the roles; what depends on the day
takes it as ``as_of``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import or_default
from ..plans.relational import whitelisted, with_fallback


def count_by(df: DataFrame, key: str, out: str = "count", blanks: bool = False) -> DataFrame:
    """Rows for each value of the key, most first. Null and blank keys are left out unless asked for."""
    rows = df if blanks else df.where(F.col(key).isNotNull() & (F.col(key) != ""))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), key)


def totals(organizations: DataFrame, events: DataFrame, domains: DataFrame, as_of: Column, event_day: str = "event_date", org: str = "organization_id", iocs: str | None = None) -> DataFrame:
    """One row: organizations, events, domains, IOCs, organizations with events in the last 7 days, and such
    events. IOCs are the domains (live), or the sum of the column ``iocs`` of the organizations (snapshot, where
    new threats are those of the day itself)."""
    recent = F.col(event_day) >= F.date_sub(as_of, 7)
    fresh = recent if iocs is None else F.col(event_day) == as_of
    e = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_distinct(F.when(recent, F.col(org))).alias("active_threats"),
        F.count(F.when(fresh, 1)).alias("new_threats"),
    )
    o = organizations.agg(F.count(F.lit(1)).alias("total_organizations"), *([F.coalesce(F.sum(iocs), F.lit(0)).alias("total_iocs")] if iocs else []))
    d = domains.agg(F.count(F.lit(1)).alias("total_domains"))
    one = o.join(F.broadcast(e)).join(F.broadcast(d))  # rows of one
    return one if iocs else one.withColumn("total_iocs", F.col("total_domains"))


def shares(total: Column, parts: Sequence[tuple[str, float]]) -> list[Column]:
    """Whole-number shares of a total, of 1 if there is none."""
    whole = F.when(total == 0, 1).otherwise(total)
    return [F.floor(whole * F.lit(s)).cast("long").alias(name) for name, s in parts]


def daily_counts(events: DataFrame, day: Column, **kinds: Column) -> DataFrame:
    """For each day its rows and, for each of ``kinds``, the rows of which it holds."""
    sums = [F.sum(F.when(test, 1).otherwise(0)).cast("long").alias(name) for name, test in kinds.items()]
    return events.groupBy(day.alias("day")).agg(F.count(F.lit(1)).alias("total"), *sums)


def trends(prepared: DataFrame, events: DataFrame, day: str, since: Column) -> DataFrame:
    """Prepared daily counts from the day ``since`` on; without any, the events of each day, all counted as
    malware."""
    zero = F.lit(0).cast("long")
    live = events.where(F.col(day) >= since).groupBy(F.col(day).alias("trend_date")).agg(F.count(F.lit(1)).alias("malware_count"))
    names = ["dns_tunnel_count", "dga_domain_count", "phishing_count", "c2_communication_count"]
    live = live.select("trend_date", *[zero.alias(n) for n in names], "malware_count")
    return with_fallback(prepared.where(F.col("trend_date") >= since).select(*live.columns), live)


def heat_map(events: DataFrame, day: Column, region: str, prepared: DataFrame | None = None) -> DataFrame:
    """Rows by day and region, null regions left out; prepared counts instead, if there are any."""
    live = events.where(F.col(region).isNotNull()).groupBy(day.alias("day"), F.col(region).alias("region")).agg(F.count(F.lit(1)).alias("count"))
    return with_fallback(prepared, live) if prepared is not None else live


def top_entities(df: DataFrame, key: str, measure: str | None, allowed: Sequence[str], n: int) -> DataFrame:
    """The n entities with the highest measure; a measure that isn't allowed becomes the first that is."""
    by = whitelisted(measure, allowed, allowed[0])
    return df.select("*", F.col(by).alias("measure")).orderBy(F.desc_nulls_last("measure"), key).limit(n)


def origin_counts(df: DataFrame, origin: Column, unknown: str = "未知") -> DataFrame:
    """Rows by origin, blank ones as unknown."""
    return df.groupBy(or_default(origin, unknown).alias("origin")).agg(F.count(F.lit(1)).alias("count"))


def region_day_rollup(events: DataFrame, organizations: DataFrame, day: Column, org: str, org_key: str, org_region: str, major: Column, unknown: str = "未知") -> DataFrame:
    """Events and major ones by day and region of their organization."""
    joined = events.join(organizations.select(F.col(org_key).alias("__org"), F.col(org_region).alias("__region")), F.col(org) == F.col("__org"), "left")
    return joined.groupBy(day.alias("day"), or_default(F.col("__region"), unknown).alias("region")).agg(F.count(F.lit(1)).alias("event_count"), F.sum(F.when(major, 1).otherwise(0)).cast("long").alias("major_count"))
