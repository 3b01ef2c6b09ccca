"""Listings of events, organizations and domains, and what is known of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.relational import all_of, latest_by_key, page


def event_filter(region: str | None = None, kind: str | None = None, organization: int | None = None, start: str | None = None, end: str | None = None, names: Mapping[str, str] | None = None) -> Column:
    """The terms that were given, as one condition; dates are inclusive, an organization of 0 is none."""
    c = {"region": "region", "kind": "event_type", "organization": "organization_id", "day": "event_date"} | dict(names or {})
    return all_of(
        [
            F.col(c["region"]) == region if region else None,
            F.col(c["kind"]) == kind if kind else None,
            F.col(c["organization"]) == organization if organization else None,
            F.col(c["day"]) >= F.lit(start).cast("date") if start else None,
            F.col(c["day"]) <= F.lit(end).cast("date") if end else None,
        ]
    )


def with_organization(rows: DataFrame, organizations: DataFrame, key: str, org_key: str, **columns: str) -> DataFrame:
    """``rows`` with columns of the organization they name; null if there is none. Spark broadcasts the
    organizations where they are small."""
    named = organizations.select(F.col(org_key).alias("__org"), *[F.col(c).alias(name) for name, c in columns.items()])
    return rows.join(named, rows[key] == named["__org"], "left").drop("__org")


def events_page(events: DataFrame, organizations: DataFrame, where: Column, key: str, org_key: str, org_name: str, day: str, tie: str, number: int, size: int) -> DataFrame:
    """A page of events, newest first, with their organization's name. The page is cut before the join."""
    rows = page(events.where(where), [F.desc(day), F.desc(tie)], number, size)
    return with_organization(rows, organizations, key, org_key, organization=org_name)


def total(rows: DataFrame, where: Column) -> DataFrame:
    """The number of rows that a paged listing with the same condition has."""
    return rows.where(where).agg(F.count(F.lit(1)).alias("total"))


def map_points(events: DataFrame, organizations: DataFrame, key: str, org_key: str, org_name: str, day: str, since: Column, places: Sequence[str]) -> DataFrame:
    """Events since a day that have a place, with their organization's name."""
    there = all_of(F.col(p).isNotNull() for p in places)
    return with_organization(events.where(there & (F.col(day) >= since)), organizations, key, org_key, organization=org_name)


def search(df: DataFrame, text: str | None, columns: Sequence[str], *terms: Column | None) -> DataFrame:
    """Rows of which a column has the text as a part, whatever the case, and the terms hold. % and _ in the
    text match as in LIKE."""
    if text and text.strip():
        like = F.lit(False)
        for c in columns:
            like = like | F.coalesce(F.lower(F.col(c)).like(f"%{text.strip().lower()}%"), F.lit(False))
        df = df.where(like)
    return df.where(all_of(terms))


def recent_first(changed: str, tie: str) -> list[Column]:
    """Newest first, rows without a day as if from 1970; then by falling id."""
    return [F.coalesce(F.col(changed).cast("date"), F.lit("1970-01-01").cast("date")).desc(), F.desc(tie)]


def attribute_counts(entities: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """``entities`` with the number of rows in each child table, 0 if there are none. Children are counted
    before the joins."""
    for name, (df, c) in children.items():
        counted = df.groupBy(F.col(c).alias("__key")).agg(F.count(F.lit(1)).alias(name))
        entities = entities.join(counted, entities[key] == counted["__key"], "left").drop("__key").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return entities


def lacking(counted: DataFrame, names: Sequence[str], limit: int | None = None, key: str | None = None) -> DataFrame:
    """Entities that lack some attribute; with a limit the first by key."""
    test = F.lit(False)
    for n in names:
        test = test | (F.col(n) == 0)
    rows = counted.where(test)
    return rows.orderBy(key).limit(limit) if limit else rows


def domain_detail(domains: DataFrame, name: str, organizations: DataFrame, whois: DataFrame, dns: DataFrame, certificates: DataFrame) -> dict[str, DataFrame]:
    """What is known of one domain: its row, the latest WHOIS, the DNS records by type and name, the latest
    certificate. Unknown names give empty frames; nothing is inserted."""
    one = with_organization(domains.where(F.lower("domain_name") == name.strip().lower()), organizations, "organization_id", "id", organization="name")
    keys = one.select(F.col("id").alias("domain_id"))
    return {
        "domain": one,
        "whois": latest_by_key(whois.join(F.broadcast(keys.limit(1)), "domain_id", "left_semi"), ["domain_id"], "query_time", "id"),
        "dns": dns.join(keys, "domain_id", "left_semi").orderBy("record_type", "record_name", "id"),
        "certificate": latest_by_key(certificates.join(F.broadcast(keys.limit(1)), "domain_id", "left_semi"), ["domain_id"], "created_at", "id"),
    }


def organization_detail(organizations: DataFrame, events: DataFrame, org: int, n: int = 50) -> tuple[DataFrame, DataFrame]:
    """An organization and its n latest events; empty frames for an unknown one."""
    return organizations.where(F.col("id") == org), events.where(F.col("organization_id") == org).orderBy(F.desc("event_date"), F.desc("id")).limit(n)


def json_field(df: DataFrame, column: str, schema: str, out: str) -> DataFrame:
    """``df`` with the column parsed; where that fails the text stays in ``out``_raw."""
    parsed = F.from_json(column, schema)
    return df.withColumn(out, parsed).withColumn(f"{out}_raw", F.when(F.try_parse_json(column).isNull(), F.col(column)))
