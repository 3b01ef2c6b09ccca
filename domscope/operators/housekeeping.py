"""What is left over: files nobody uses, stored objects nobody knows, rows to be moved or dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.relational import delete_cascading, missing_from, update_rows

# What a match may be marked as.
MATCH_STATUS = ("pending", "confirmed", "rejected", "ignored", "reviewing")


def orphan_files(files: DataFrame, tasks: DataFrame, alert_files: DataFrame) -> DataFrame:
    """Files that neither a task nor an alert names."""
    return missing_from(files, "id", (tasks, "file_id"), (alert_files, "file_id"))


def unknown_objects(listing: DataFrame, files: DataFrame, tasks: DataFrame) -> DataFrame:
    """Stored objects (column key) that no file row and no task's result names."""
    results = tasks.select(F.get_json_object("extra", "$.result_file_key").alias("key"))
    return missing_from(listing, "key", (files, "object_key"), (results, "key"))


def drop_alerts(alerts: DataFrame, gone: Column, alert_files: DataFrame, matches: DataFrame, details: DataFrame) -> dict[str, DataFrame]:
    """All alert tables without the alerts that fit, and what hangs on them."""
    dropped = alerts.where(gone)
    rest = delete_cascading(dropped, "alert_id", {"alert_files": (alert_files, "alert_id"), "alert_domain_matches": (matches, "alert_id"), "alert_details": (details, "alert_id")})
    return {"alerts": alerts.where(~gone | gone.isNull()), **rest}


def move_details(alerts: DataFrame, column: str = "high_risk_domains") -> tuple[DataFrame, DataFrame]:
    """The alerts without a bulky column, and a side table of it for those that have one."""
    return alerts.drop(column), alerts.where(F.col(column).isNotNull()).select("alert_id", column)


def mark_match(matches: DataFrame, match: int, status: str) -> DataFrame:
    """``matches`` with one marked anew; the status is trimmed and lower-cased, and must be known."""
    status = status.strip().lower()
    if status not in MATCH_STATUS:
        raise ValueError(f"status must be one of {', '.join(MATCH_STATUS)}")
    return update_rows(matches, F.col("id") == match, status=F.lit(status))


def match_search(matches: DataFrame, domain: str | None = None, organization: str | None = None, confidence: str | None = None, status: str | None = None) -> DataFrame:
    """Matches that fit what is given, highest scores first, those without a score last, then newest."""
    rows = matches
    for c, part in (("domain_name", domain), ("organization_name", organization)):
        if part and part.strip():
            rows = rows.where(F.lower(c).like(f"%{part.strip().lower()}%"))
    for c, value in (("confidence", confidence), ("status", status)):
        if value and value.strip():
            rows = rows.where(F.col(c) == value.strip())
    return rows.orderBy(F.desc_nulls_last("actor_score"), F.desc("created_at"), F.desc("id"))


def owned_matches(matches: DataFrame, alerts: DataFrame, user: int) -> DataFrame:
    """The matches of the user's alerts. Ownership comes before paging."""
    return matches.join(alerts.where(F.col("user_id") == user), "alert_id", "left_semi")


def alert_domains(alerts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row for each domain in an alert's stored document: alert_id, domain, risk_score, risk_level."""
    schema = "struct<high_risk_domains: array<struct<domain: string, risk_score: double, risk_level: string>>>"
    read = snapshots.select("alert_id", F.explode(F.from_json("document", schema)["high_risk_domains"]).alias("d")).select("alert_id", "d.*")
    return alerts.select("alert_id").join(read, "alert_id")
