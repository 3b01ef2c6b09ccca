"""Staged text tables into typed ones, and the tables of counts built from these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import UNKNOWN, blank_to_null, mixed_date, or_default, pipe_list, slash_date, to_int
from ..functions.labels import event_type, severity
from ..plans.relational import first_by_key, update_from


def organizations(staged: DataFrame) -> DataFrame:
    """Typed organizations; rows without a name are left out."""
    count = lambda c: F.coalesce(to_int(F.col(c)), F.lit(0))
    return staged.where(blank_to_null(F.col("name")).isNotNull()).select(
        to_int(F.col("id")).alias("id"),
        F.trim("name").alias("name"),
        pipe_list(F.col("aliases")).alias("alias"),
        blank_to_null(F.col("description")).alias("description"),
        count("ioc_count").alias("ioc_count"),
        count("event_count").alias("event_count"),
        slash_date(F.col("update_time")).alias("update_time"),
        or_default(F.col("region"), UNKNOWN).alias("region"),
        or_default(F.col("origin"), UNKNOWN).alias("origin"),
        pipe_list(F.col("target_countries")).alias("target_countries"),
        pipe_list(F.col("target_industries")).alias("target_industries"),
    )


def events(staged: DataFrame, orgs: DataFrame) -> DataFrame:
    """Typed events, each with the region of its organization, or unknown."""
    e = staged.select(
        to_int(F.col("id")).alias("id"),
        slash_date(F.col("event_date")).alias("event_date"),
        F.left(F.trim("title"), F.lit(255)).alias("title"),
        F.when(F.col("description") != "", F.col("description")).alias("description"),
        event_type(F.coalesce("threat_type", F.lit(""))).alias("event_type"),
        to_int(F.col("organization_id")).alias("organization_id"),
        severity(F.coalesce("threat_type", F.lit(""))).alias("severity"),
        blank_to_null(F.col("link")).alias("report_url"),
    )
    regions = orgs.select(F.col("id").alias("__org"), F.col("region").alias("__region"))
    joined = e.join(regions, e["organization_id"] == regions["__org"], "left")
    return joined.withColumn("region", or_default(F.col("__region"), UNKNOWN)).drop("__org", "__region")


def domains(staged: DataFrame) -> DataFrame:
    """Typed domains, one for each lower-case name (that with the smallest id); rows without a name are left
    out, dates that can't be read are null."""
    rows = staged.where(blank_to_null(F.col("domain_name")).isNotNull()).select(
        to_int(F.col("id")).alias("id"),
        F.lower(F.trim("domain_name")).alias("domain_name"),
        F.coalesce(to_int(F.col("is_malicious")) > 0, F.lit(False)).alias("is_malicious"),
        mixed_date(F.col("first_seen")).alias("first_seen"),
        mixed_date(F.col("last_seen")).alias("last_seen"),
        to_int(F.col("organization_id")).alias("organization_id"),
    )
    return first_by_key(rows, ["domain_name"], [F.asc_nulls_last("id")])


def backfill_organization(table: DataFrame, staged: DataFrame) -> DataFrame:
    """``table`` of domains with the organization of the staged row of the same id, or else name."""
    s = staged.select(to_int(F.col("id")).alias("id"), F.lower(F.trim("domain_name")).alias("name"), to_int(F.col("organization_id")).alias("org"))
    by_id = first_by_key(s.where("id IS NOT NULL"), ["id"], [F.asc_nulls_last("org")])
    by_name = first_by_key(s.where("name <> ''"), ["name"], [F.asc_nulls_last("org")])
    once = update_from(table, by_id, F.expr("t.id = s.id"), organization_id="org")
    return update_from(once, by_name, F.expr("lower(trim(t.domain_name)) = s.name"), only_blank=True, organization_id="org")


def backfill_links(table: DataFrame, staged: DataFrame) -> DataFrame:
    """``table`` of events with the staged link where it has none."""
    s = first_by_key(staged.select(to_int(F.col("id")).alias("id"), blank_to_null(F.col("link")).alias("link")).where("id IS NOT NULL AND link IS NOT NULL"), ["id"], [F.col("link")])
    return update_from(table, s, F.expr("t.id = s.id"), only_blank=True, report_url="link")


def audit(table: DataFrame, c: str) -> DataFrame:
    """Rows, and how many have the column and how many lack it."""
    return table.agg(F.count(F.lit(1)).alias("total"), F.count(c).alias("filled"), F.count(F.when(F.col(c).isNull(), 1)).alias("missing"))


def threat_trends(evts: DataFrame) -> DataFrame:
    """Daily counts: events that speak of phishing, of C2, and all."""
    # The words looked for.
    says = lambda word: F.coalesce(F.contains("title", F.lit(word)), F.lit(False)) | F.coalesce(F.contains("description", F.lit(word)), F.lit(False))
    count = lambda t: F.sum(F.when(t, 1).otherwise(0)).cast("long")
    zero = F.lit(0).cast("long")
    sums = evts.groupBy(F.col("event_date").alias("trend_date")).agg(count(says("钓鱼")).alias("phishing_count"), count(says("C2")).alias("c2_communication_count"), F.count(F.lit(1)).alias("malware_count"))
    return sums.select("trend_date", zero.alias("dns_tunnel_count"), zero.alias("dga_domain_count"), "phishing_count", "c2_communication_count", "malware_count")


def attack_sources(orgs: DataFrame, as_of: Column) -> DataFrame:
    """Organizations by origin, as of a day."""
    return orgs.groupBy(or_default(F.col("origin"), UNKNOWN).alias("country")).agg(F.count(F.lit(1)).alias("attack_count")).withColumn("last_attack_date", as_of)
